"""Array helpers that keep per-row work linear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 32


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda Catalyst substitutes expressions, so a costly expression
    used there would run once per element. A lambda variable is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def empty_array(element: str) -> Column:
    return F.expr(f"cast(array() as array<{element}>)")


def explode_rows(df: DataFrame, keep: list[str], items: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per element of a computed array, with its zero-based ``position`` if named.

    A plain explode makes the optimizer add a filter on the array's size below it,
    which repeats the expression that computes the array. The outer form does not.
    Elements must not be null.
    """
    if position:
        rows = df.select(*keep, F.posexplode_outer(items).alias(position, name))
    else:
        rows = df.select(*keep, F.explode_outer(items).alias(name))
    return rows.filter(F.col(name).isNotNull())


def _scan_block(items: Column, start: Column, combine: Callable[[Column, Column], Column]) -> Column:
    zero = F.struct(start.alias("at"), empty_array("int").alias("seen"))
    return F.aggregate(
        items,
        zero,
        lambda acc, x: F.struct(
            combine(acc["at"], x).alias("at"),
            F.concat(acc["seen"], F.array(acc["at"])).alias("seen"),
        ),
    )["seen"]


def running_before(
    items: Column, start: int, combine: Callable[[Column, Column], Column]
) -> Column:
    """For every element of an ``array<int>``: ``combine`` folded over those before it.

    ``combine`` must be associative. Spark copies the accumulator of
    ``aggregate`` at every step, so a plain fold that grows an array is
    quadratic; folding blocks of fixed size first keeps it near linear.
    """

    def blocks_of(arr: Column) -> Column:
        last = F.floor((F.size(arr) - 1) / F.lit(_BLOCK)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: F.slice(arr, i * _BLOCK + 1, F.lit(_BLOCK))
        )

    def over_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(start), combine))
        offsets = bind(totals, lambda t: _scan_block(t, F.lit(start), combine))
        return F.flatten(F.zip_with(blocks, offsets, lambda b, o: _scan_block(b, o, combine)))

    def whole(arr: Column) -> Column:
        return F.when(F.size(arr) <= 0, empty_array("int")).otherwise(
            bind(blocks_of(arr), over_blocks)
        )

    return bind(items, whole)
