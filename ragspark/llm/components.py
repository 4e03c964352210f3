"""Connected components of a graph kept in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import written
from ragspark.operators.hotkeys import salted_join


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of the links ``a, b``; the root is the smallest node of the component.

    Each round points every node at its smallest neighbour, follows the pointers twice and puts the
    ends in place of the nodes, so the graph shrinks to nothing in a few rounds, and neighbours are only
    ever aggregated, never listed. Each round is a written table. Nulls link nothing. A hub, or a node that much points at, is
    split wherever it is joined.
    """
    edges = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    ends = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).withColumn("to", F.least("node", "to"))
        if edges.isEmpty():
            break
        step = written(_follow(written(_follow(written(first, "first")), "pointers")), "pointers")
        ends = step if ends is None else written(_moved(ends, step, "to"), "ends")
        near = written(_moved(edges, step, "a"), "links")
        edges = written(
            _moved(near, step, "b")
            .filter("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct(),
            "links",
        )
    if ends is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.select("node", F.col("to").alias("root"))


def _moved(frame: DataFrame, step: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by what its value points at, where it points."""
    at = step.select(F.col("node").alias(column), F.col("to").alias("__to"))
    joined = salted_join(frame, at, [column])
    return joined.withColumn(column, F.coalesce("__to", column)).drop("__to").select(*frame.columns)


def _follow(step: DataFrame) -> DataFrame:
    return _moved(step, step, "to")
