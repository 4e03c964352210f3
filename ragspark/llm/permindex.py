"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by the order in which the pivots are near
to it, and posted in the inverted files of its nearest pivots. A query goes to the files of its own nearest
pivots; in each, postings are ranked by the footrule distance of the orders, and the best are reranked
by the inner product of the original vectors in double precision. A file returns its ``k`` best, so at most ``k``
times the files visited meet for a query in the end.

Largest inner product is turned into nearness first: a data vector gets one more component that brings it to
the largest norm, a query gets zero there. With unit vectors that component is 0.

Equal vectors are one class, posted once with its ``k + 1`` smallest ids, so a vector that a third of all rows
share costs one posting. Files are cut in blocks of rows and queries in blocks too, so a task holds one block of
each. Vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part. Repeated rows count once. Fewer candidates than ``k`` give fewer rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.llm.common import written

#: Size of the pivot sample; 256 ranks fit a byte.
PIVOTS = 256
#: Inverted files that a vector is posted in and a query visits.
POSTED, VISITED = 16, 16
#: Postings of a file that are reranked for a query, best footrule first.
RERANKED = 100
#: Rows of a block of a file and of a block of its queries.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024


@dataclass
class Pivots:
    """Pivots in the space with the norm component, and the largest norm."""

    points: np.ndarray
    norm: float

    def orders(self, vectors: np.ndarray, data: bool) -> np.ndarray:
        """Rank of each pivot for each vector, as bytes; nearest first, ties to the smaller pivot."""
        extra = np.sqrt(np.maximum(self.norm**2 - (vectors * vectors).sum(axis=1), 0)) if data else np.zeros(len(vectors))
        near = np.column_stack([vectors, extra]) @ self.points.T
        order = np.argsort(-near, axis=1, kind="stable")
        ranks = np.empty(order.shape, np.uint8)
        np.put_along_axis(ranks, order, np.arange(order.shape[1], dtype=np.uint8)[None], axis=1)
        return ranks


def valid(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v`` of the rows that can take part: as many components as most rows have, all finite, not all zero.

    Single precision is kept as it is; other numbers become doubles.
    """
    kind = vectors.schema[vector].dataType.simpleString()
    v = F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    good = rows.filter(
        "v is not null and id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    )
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit(classes: DataFrame, pivots: int = PIVOTS) -> Pivots:
    """Pivots are the first ``pivots`` distinct vectors by hash; the largest norm is that of all."""
    norm = classes.agg(F.max(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))).collect()[0][0] or 0.0
    taken = classes.orderBy(F.xxhash64("v"), "first").limit(min(pivots, 256)).select("v").toArrow()
    points = _matrix(taken.column("v").combine_chunks()).astype(np.float64) if taken.num_rows else np.zeros((0, 0))
    norm = float(np.sqrt(norm))
    extra = np.sqrt(np.maximum(norm**2 - (points * points).sum(axis=1), 0)) if len(points) else np.zeros(0)
    return Pivots(np.column_stack([points, extra]) if len(points) else points, norm)


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """``first, ids, v``: distinct vectors with their ``k + 1`` smallest ids (a query may be one of them)."""
    order = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("n", F.dense_rank().over(order)).filter(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("first"), "ids", "v")


def _posted(rows: DataFrame, pivots: Pivots, files: int, data: bool) -> DataFrame:
    """A row for each of the nearest pivots: ``pivot, key, ids, ranks, v``; ranks and vector as bytes."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                vectors = _matrix(part.column("v"))
                ranks = pivots.orders(vectors.astype(np.float64), data)
                n, m = ranks.shape
                nearest = np.argsort(ranks, axis=1, kind="stable")[:, : min(files, m)]
                take = pa.array(np.repeat(np.arange(n), nearest.shape[1]))
                raw = pa.array([r.tobytes() for r in ranks], pa.binary())
                body = pa.array([v.tobytes() for v in vectors], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nearest.ravel().astype(np.int32)), *(c.take(take) for c in (part.column("key"), part.column("ids"), raw, body))],
                    ["pivot", "key", "ids", "ranks", "v"],
                )

    return rows.mapInArrow(run, "pivot int, key long, ids array<long>, ranks binary, v binary")


def footrule(ranks: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Sum of the absolute differences of ranks to those of one query; rows of bytes."""
    apart = np.maximum(ranks, query)
    np.subtract(apart, np.minimum(ranks, query), out=apart)
    n, m = apart.shape
    if m % 8:
        return apart.sum(axis=1, dtype=np.int64)
    # bytes summed eight at a time, in lanes of 16 bits: 32 words of two bytes stay below 2**16
    words = apart.view(np.uint64)
    low = np.uint64(0x00FF00FF00FF00FF)
    lanes = ((words & low) + ((words >> np.uint64(8)) & low)).sum(axis=1, dtype=np.uint64)
    return lanes.view(np.uint16).reshape(n, 4).sum(axis=1, dtype=np.int64)


def search(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    pivots: int = PIVOTS,
    posted: int = POSTED,
    visited: int = VISITED,
    reranked: int = RERANKED,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` found for each query, its own id left out, ties to smaller ids.

    ``rows`` and ``queries`` are ``id, v`` as :func:`valid` gives them. Queries of one vector and id repeat.
    """
    classes = written(classes_of(rows, k), "classes")
    index = fit(classes, pivots)
    if not len(index.points):
        return queries.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).filter("false")
    entries = _posted(classes.select(F.col("first").alias("key"), "ids", "v"), index, posted, True)
    kind = np.float32 if classes.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    asked = queries.select(F.col("id").alias("key"), F.array("id").alias("ids"), "v")
    probes = _posted(asked, index, visited, False)

    # a row for each pivot: how many blocks its file and its queries are cut in
    held = entries.groupBy("pivot").count().collect()
    wanted = queries.count()
    blocks = {r["pivot"]: -(-r["count"] // BLOCK_ROWS) for r in held}
    asks = max(1, -(-wanted * min(visited, len(index.points)) // (QUERY_ROWS * max(1, len(blocks)))))
    of_file = F.create_map(*[F.lit(x) for pair in sorted(blocks.items()) for x in pair])[F.col("pivot")]

    def placed(side: DataFrame, own: str, count, other: str, others) -> DataFrame:
        """Each row in its own block, once for every block of the other side."""
        return side.withColumn(own, F.pmod(F.xxhash64("key", "v"), count).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), others - 1)))

    unit = ["pivot", "block", "ask"]
    a = placed(entries, "block", of_file, "ask", F.lit(asks)).withColumn("probe", F.lit(False))
    b = placed(probes.filter(of_file.isNotNull()), "ask", F.lit(asks), "block", of_file).withColumn("probe", F.lit(True))

    def meet(group: pa.Table) -> pa.Table:
        probe = group.column("probe").to_numpy()
        file, asking = group.filter(pa.array(~probe)).combine_chunks(), group.filter(pa.array(probe)).combine_chunks()
        out_q, out_v, out_s = [], [], []
        if file.num_rows and asking.num_rows:
            order = pa.compute.sort_indices(file, [("key", "ascending")])
            file = file.take(order).combine_chunks()
            matrix = lambda t, c, of: np.frombuffer(b"".join(t.column(c).to_pylist()), of).reshape(t.num_rows, -1)
            ranks, vectors = matrix(file, "ranks", np.uint8), matrix(file, "v", kind).astype(np.float64)
            asked_ranks, asked_vectors = matrix(asking, "ranks", np.uint8), matrix(asking, "v", kind).astype(np.float64)
            ids, pivot = file.column("ids").to_pylist(), group.column("pivot")[0].as_py()
            mine = ranks < posted
            for own, query, vector in zip(asking.column("key").to_pylist(), asked_ranks, asked_vectors):
                # a posting counts in the first file that it shares with the query, not in each
                earlier = np.flatnonzero(query < query[pivot])
                fresh = np.flatnonzero(~mine[:, earlier].any(axis=1)) if len(earlier) else np.arange(len(ranks))
                if not len(fresh):
                    continue
                apart = footrule(ranks[fresh], query)
                if len(fresh) > reranked:
                    edge = np.partition(apart, reranked - 1)[reranked - 1]
                    fresh = fresh[apart <= edge]  # all of the last distance, so that ties cost none
                scores = np.einsum("ij,j->i", vectors[fresh], vector)
                if len(fresh) > k + 1:
                    least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    chosen = np.flatnonzero(scores >= least)
                else:
                    chosen = np.arange(len(fresh))
                best = sorted((-scores[c], i) for c in chosen for i in ids[fresh[c]] if i != own)[:k]
                out_q += [own] * len(best)
                out_v += [i for _, i in best]
                out_s += [-s for s, _ in best]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    columns = [*unit, "probe", "key", "ids", "ranks", "v"]
    found = a.select(columns).unionByName(b.select(columns)).groupBy(*unit).applyInArrow(meet, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
