"""Numbering and neighbours inside a key, without a task per key.

A window over a key sorts the whole key in one task. Here a key is cut into
ranges of about equal numbers of rows; only one row per range (a count, or its first and
last row) is windowed over the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragspark.operators.hotkeys import salted_join

_RANGE = "__range"
_CUTS = 128


def _ranged(df: DataFrame, keys: list[str], order: str, rows: int) -> DataFrame:
    """Cut each key of more than ``rows`` rows into ranges of about equal numbers of rows.

    The cuts are quantiles of the key's own order values, so neither gaps nor outliers matter.
    """
    shares = [i / _CUTS for i in range(1, _CUTS)]
    cuts = (
        df.groupBy(*keys)
        .agg(F.percentile_approx(order, shares, 10 * _CUTS).alias("__cuts"), F.count("*").alias("__rows"))
        .select(*keys, F.when(F.col("__rows") > rows, F.array_distinct("__cuts")).alias("__cuts"))
    )
    below = F.size(F.filter("__cuts", lambda c: c < F.col(order)))
    # the rows of a busy key do not meet its cuts in one task
    return salted_join(df, cuts, keys, "inner", F.xxhash64(*keys, order)).withColumn(_RANGE, F.when(F.col("__cuts").isNotNull(), below).otherwise(0)).drop("__cuts")


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: str,
    name: str = "n",
    total: str | None = None,
    rows: int = 10_000,
) -> DataFrame:
    """Number rows 1..n inside ``keys`` by a unique, non-null integer ``order`` column.

    ``total`` names a column for the number of rows of the key.
    """
    cut = _ranged(df, keys, order, rows)
    by_key = Window.partitionBy(*keys).orderBy(_RANGE)
    before = (
        cut.groupBy(*keys, _RANGE)
        .agg(F.count("*").alias("__size"))
        .withColumn("__before", F.sum("__size").over(by_key) - F.col("__size"))
    )
    if total:
        before = before.withColumn(total, F.sum("__size").over(Window.partitionBy(*keys)))
    before = before.drop("__size")
    inside = Window.partitionBy(*keys, _RANGE).orderBy(order)
    return (
        cut.join(before, [*keys, _RANGE])
        .withColumn(name, F.row_number().over(inside) + F.col("__before"))
        .drop(_RANGE, "__before")
    )


def with_neighbours(
    df: DataFrame, keys: list[str], order: str, columns: list[str], rows: int = 10_000
) -> DataFrame:
    """Add structs ``previous`` and ``following`` holding ``columns`` of the adjacent rows."""
    cut = _ranged(df, keys, order, rows).withColumn("__row", F.struct(*columns))
    by_key = Window.partitionBy(*keys).orderBy(_RANGE)
    edges = (
        cut.groupBy(*keys, _RANGE)
        .agg(F.min_by("__row", order).alias("__first"), F.max_by("__row", order).alias("__last"))
        .select(
            *keys,
            _RANGE,
            F.lag("__last").over(by_key).alias("__left"),
            F.lead("__first").over(by_key).alias("__right"),
        )
    )
    inside = Window.partitionBy(*keys, _RANGE).orderBy(order)
    return (
        cut.join(edges, [*keys, _RANGE])
        .withColumn("previous", F.coalesce(F.lag("__row").over(inside), F.col("__left")))
        .withColumn("following", F.coalesce(F.lead("__row").over(inside), F.col("__right")))
        .drop(_RANGE, "__row", "__left", "__right")
    )
