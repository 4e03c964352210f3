"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of all rows is split. So at most that many keys are, whatever the size of the table.
PARTS = 1000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", spread: Column | None = None) -> DataFrame:
    """``left`` joined to ``right``, which holds each key once, on key columns without nulls.

    A key with more than 1 / ``PARTS`` of the rows of ``left`` is cut into pieces of about that size by ``spread`` (a hash of
    all columns unless given; it should differ between rows of a key and must not depend on the run), and its row of
    ``right`` is repeated for each piece: at most 2 x ``PARTS`` more rows. The list of such keys, at most ``PARTS`` rows,
    is the only thing broadcast.
    """
    total = max(left.count(), 1)
    heavy = (
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") * PARTS > total)
        .select(*keys, F.ceil(F.col("__n") * PARTS / F.lit(total)).cast("int").alias("__pieces"))
    )
    pieces = F.coalesce("__pieces", F.lit(1))
    salt = F.pmod(F.xxhash64(*left.columns) if spread is None else spread, pieces).cast("int")
    split = left.join(F.broadcast(heavy), keys, "left").withColumn("__salt", salt).drop("__pieces")
    each = F.explode(F.sequence(F.lit(0), pieces - 1)).alias("__salt")
    repeated = right.join(F.broadcast(heavy), keys, "left").select(*right.columns, each)
    return split.join(repeated, [*keys, "__salt"], how).drop("__salt")
