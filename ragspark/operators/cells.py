"""Retrieval through an inverted file of centroids: exact with skipped cells, or approximate to a stated recall.

Every vector belongs to one cell and knows its distance to the cell's centroid, its residual norm; a cell knows its smallest,
largest and mean. A question at distance ``D`` from a centroid is ``sqrt(D^2 + r^2 - 2 D r c)`` from a vector of
residual norm ``r``, where ``c`` is the cosine between the two directions from the centroid. At ``c = 1`` that is the triangle inequality,
and visiting every cell whose bound does not exceed the cost of the k-th hit so far finds exactly the nearest vectors. In many
dimensions directions are nearly at right angles, so that bound is far too careful. The approximate search also stops at cells in
which a vector of mean residual would need a larger cosine than a quantile of those that the cells of true neighbours of some
questions need: the wanted recall is that quantile.

A search has two rounds. The first visits the nearest cells of a question, enough to hold a few times ``k`` vectors, and so
bounds the k-th cost; the second visits all other cells that the bound leaves. Each round shuffles the vectors of
visited cells once, so the shuffle is linear in the table. Large cells are cut into slices, so a task holds one slice
at a time, whatever the size of a cell or the number of partitions; questions stream past it.

Centroids are fitted on a bounded sample (``SAMPLE_ROWS`` a centroid, ``SAMPLE_BYTES`` in all, the rows of smallest hash of the id); every vector is indexed.
Their number is the square root of the number of vectors, ``MOST_CELLS`` at most. Centroids and the figures of cells, bounded by that
number, are all that the driver keeps and ships.

Null vectors are left out; all vectors have one length. A question that is asked twice is asked once, with the smaller vector. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.operators.retrieval import METRICS, _ids, _matrix, _nearest, _score
from ragspark.session import fresh_dir, stored

MOST_CELLS = 4096
SAMPLE_ROWS = 32
SAMPLE_BYTES = 64 << 20
#: Bytes of vectors, as doubles, that a task holds.
SLICE_BYTES = 8 << 20
#: Questions that the approximate search answers exactly to learn how directions lie.
TRIALS = 64
# Vectors that the first round looks at, as a multiple of k.
_AHEAD = 8
_FIRST = 4


@dataclass(frozen=True)
class Cells:
    """The figures of each cell: what tasks need to choose visits."""

    centroids: np.ndarray
    near: np.ndarray
    far: np.ndarray
    mean: np.ndarray
    sizes: np.ndarray
    parts: np.ndarray
    metric: str

    def apart(self, questions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a cost is made of besides the residual: for ``dot`` the products with centroids and the sizes of questions, else distances twice."""
        if self.metric == "dot":
            size = np.sqrt(np.einsum("ij,ij->i", questions, questions))
            return questions @ self.centroids.T, np.repeat(size[:, None], len(self.centroids), axis=1)
        far = _distances(_unit(questions, self.metric), self.centroids)
        return far, far

    def bounds(self, questions: np.ndarray) -> np.ndarray:
        """Least cost that a vector of each cell can have, for each question."""
        far, size = self.apart(questions)
        if self.metric == "dot":
            return -far - size * self.far
        cost = np.maximum(np.maximum(far - self.far, self.near - far), 0.0) ** 2
        return cost / 2 if self.metric == "cosine" else cost

    def cosines(self, questions: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The cosine that a vector of mean residual needs for a cost of ``limit``, one a question, in each cell."""
        far, size = self.apart(questions)
        if self.metric == "dot":
            up, down = -limit - far, size * self.mean
        else:
            up, down = far**2 + self.mean**2 - limit * (2 if self.metric == "cosine" else 1), 2 * far * self.mean
        return np.divide(up, down, out=np.where(up <= 0, -np.inf, np.inf), where=down > 0)


@dataclass(frozen=True)
class CellIndex:
    """Vectors with their cells (``__cell, __part, __id, __r, __v``), and the figures of the cells."""

    rows: DataFrame
    cells: Cells


def _unit(m: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return m
    size = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """k-means from the first ``cells`` rows; a centroid that loses all rows stays where it is."""
    centroids = sample[:cells].copy()
    for _ in range(rounds):
        nearest = np.concatenate([_distances(sample[i : i + 4096], centroids).argmin(axis=1) for i in range(0, len(sample), 4096)])
        order = np.argsort(nearest, kind="stable")
        found, starts = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(sample[order], starts, axis=0)
        centroids[found] = sums / np.diff(np.append(starts, len(sample)))[:, None]
    return centroids


def build_index(
    vectors: DataFrame,
    vid: str = "vec_id",
    vector: str = "embedding",
    metric: str = "l2",
    cells: int | None = None,
    slice_bytes: int = SLICE_BYTES,
    path: str | None = None,
) -> CellIndex:
    """Index all vectors; the table is written to ``path``, or to the shared folder unless given."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark = vectors.sparkSession
    known = vectors.select(F.col(vid).alias("__id"), F.col(vector).cast("array<double>").alias("__v")).filter(F.col("__v").isNotNull())
    row = known.agg(F.count("__v").alias("n"), F.max(F.size("__v")).alias("dim")).first()
    count, dim = row["n"], max(row["dim"] or 1, 1)
    cells = max(1, min(cells or int(np.ceil(np.sqrt(count))), MOST_CELLS, count))
    limit = min(SAMPLE_ROWS * cells, max(cells, SAMPLE_BYTES // (8 * dim)))
    some = known.orderBy(F.xxhash64("__id"), "__id").limit(limit).select("__v").toArrow()
    sample = _unit(_matrix(some.column(0).combine_chunks()), metric) if count else np.zeros((1, dim))
    centroids = fit_centroids(sample, cells)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = _distances(_unit(_matrix(batch.column(1)), metric), centroids)
            cell = apart.argmin(axis=1)
            columns = [pa.array(cell.astype(np.int32)), batch.column(0), pa.array(apart[np.arange(len(cell)), cell]), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["__cell", "__id", "__r", "__v"])

    schema = T.StructType(
        [T.StructField("__cell", T.IntegerType()), known.schema["__id"], T.StructField("__r", T.DoubleType()), known.schema["__v"]]
    )
    path = path or fresh_dir(spark, "cells")
    known.mapInArrow(place, schema).write.parquet(path)
    placed = spark.read.schema(schema).parquet(path)
    wanted = [F.count("*"), F.min("__r"), F.max("__r"), F.avg("__r")]
    figures = np.zeros((4, cells))
    for cell, *values in placed.groupBy("__cell").agg(*wanted).collect():
        figures[:, cell] = values
    sizes, near, far, mean = figures[0].astype(np.int64), *figures[1:]
    parts = np.maximum(1, -(-sizes * dim * 8 // slice_bytes))
    of_cell = F.element_at(F.lit(parts.tolist()), F.col("__cell") + 1)
    rows = placed.withColumn("__part", F.pmod(F.xxhash64("__id"), of_cell).cast("int")).select("__cell", "__part", "__id", "__r", "__v")
    return CellIndex(rows, Cells(centroids, near, far, mean, sizes, parts, metric))


def _visits(cells: Cells, asked: DataFrame, k: int, cosine: float | None, second: bool) -> DataFrame:
    """``__cell, __part, __q, __v, __limit``: where each question goes; in the second round ``asked`` knows a ``__limit``."""
    q_field = asked.schema["__q"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                questions = _matrix(batch.column(1))
                lowest = cells.bounds(questions)
                # nearest first: by the centroid, as bounds of many cells may be equal
                order = np.argsort(cells.apart(questions)[0] * (-1 if cells.metric == "dot" else 1), axis=1, kind="stable")
                before = np.cumsum(cells.sizes[order], axis=1) - cells.sizes[order]
                chosen = np.zeros(lowest.shape, dtype=bool)
                np.put_along_axis(chosen, order, (before < _AHEAD * k) | (np.arange(lowest.shape[1]) < _FIRST), axis=1)
                if second:
                    limit = batch.column(2).to_numpy(zero_copy_only=False)[:, None]
                    # a little above the limit, as costs are rounded
                    within = lowest <= limit + 1e-9 * np.abs(limit) + 1e-12
                    if cosine is not None:
                        within &= cells.cosines(questions, limit) <= cosine
                    chosen = ~chosen & within
                q, cell = np.nonzero(chosen & (cells.sizes > 0))
                parts = cells.parts[cell]
                q, cell = np.repeat(q, parts), np.repeat(cell, parts)
                part = np.arange(len(q)) - np.repeat(np.cumsum(parts) - parts, parts)
                take = pa.array(q)
                columns = [pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), *(batch.column(i).take(take) for i in range(3))]
                yield pa.RecordBatch.from_arrays(columns, names=["__cell", "__part", "__q", "__v", "__limit"])

    schema = T.StructType(
        [T.StructField("__cell", T.IntegerType()), T.StructField("__part", T.IntegerType()), q_field, asked.schema["__v"], T.StructField("__limit", T.DoubleType())]
    )
    return asked.select("__q", "__v", "__limit").mapInArrow(run, schema)


def _probe(index: CellIndex, visits: DataFrame, k: int) -> DataFrame:
    """``__q, __id, __cost, __cell, __r``: the k nearest within each visited slice, none above the question's limit."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_field, q_field = index.rows.schema["__id"], visits.schema["__q"]
    none = F.lit(None)
    needed = visits.select("__cell").distinct()
    held = index.rows.join(F.broadcast(needed), "__cell", "left_semi").select(
        "__cell", "__part", F.lit(False).alias("__asks"), none.cast(q_field.dataType).alias("__q"), "__id", "__r", "__v"
    )
    asks = visits.select("__cell", "__part", F.lit(True).alias("__asks"), "__q", none.cast(id_field.dataType).alias("__id"), F.col("__limit").alias("__r"), "__v")
    schema = T.StructType(
        [q_field, id_field, T.StructField("__cost", T.DoubleType()), T.StructField("__cell", T.IntegerType()), T.StructField("__r", T.DoubleType())]
    )
    id_type, metric = to_arrow_type(id_field.dataType), index.cells.metric

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held_v, ids, residual = None, [], None, None, None
        for batch in batches:
            cell, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(cell)]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if (cell[a], part[a]) != at:
                    at, parts, held_v = (cell[a], part[a]), [], None
                own = int(np.searchsorted(piece.column(2).to_numpy(zero_copy_only=False), True))
                if own:
                    mine = piece.slice(0, own)
                    parts.append((_ids(mine.column(4)), mine.column(5).to_numpy(), _matrix(mine.column(6))))
                if own == len(piece) or not parts:
                    continue
                if held_v is None:
                    ids, residual, held_v = (np.concatenate(x) for x in zip(*parts))
                some = piece.slice(own)
                q, v, cost = _nearest(_matrix(some.column(6)), held_v, ids, k, metric)
                limit = some.column(5).to_numpy(zero_copy_only=False)[q]
                near = cost <= limit + 1e-9 * np.abs(limit) + 1e-12
                q, v, cost = q[near], v[near], cost[near]
                columns = [some.column(3).take(pa.array(q)), pa.array(ids[v].tolist(), type=id_type), pa.array(cost)]
                columns += [pa.array(np.full(len(q), at[0], dtype=np.int32)), pa.array(residual[v])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    together = held.union(asks).repartition("__cell", "__part").sortWithinPartitions("__cell", "__part", "__asks")
    return together.mapInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("__q").orderBy("__cost", "__id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _two_rounds(index: CellIndex, asked: DataFrame, k: int, cosine: float | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The hits, all visits with their round (``__early``), and the questions with the limit of the first round."""
    open_ = asked.withColumn("__limit", F.lit(float("inf")))
    first = stored(_visits(index.cells, open_, k, cosine, second=False), "visits")
    early = stored(_best(_probe(index, first, k), k), "hits")
    reached = early.filter(F.col("rank") == k).select("__q", F.col("__cost").alias("__limit"))
    limited = asked.join(reached, "__q", "left").fillna(float("inf"), ["__limit"])
    second = stored(_visits(index.cells, limited, k, cosine, second=True), "visits")
    late = _best(_probe(index, second, k), k)
    hits = _best(early.drop("rank").union(late.drop("rank")), k)
    where = ["__cell", "__part", "__q"]
    visits = first.select(*where, F.lit(True).alias("__early")).union(second.select(*where, F.lit(False).alias("__early")))
    return hits, visits, limited


def _asked(questions: DataFrame, qid: str, vector: str) -> DataFrame:
    known = questions.select(F.col(qid).alias("__q"), F.col(vector).cast("array<double>").alias("__v")).filter(F.col("__v").isNotNull())
    return stored(known.groupBy("__q").agg(F.min("__v").alias("__v")), "asked")


def neighbour_cosine(index: CellIndex, asked: DataFrame, k: int, recall: float, trials: int = TRIALS) -> float:
    """The cosine at which the share ``recall`` of true neighbours is reached, and a margin for the size of the trial.

    ``trials`` questions, those of smallest hash, are answered exactly over the whole index; what a neighbour needs is the
    cosine of its cell for the limit that the first round leaves its question with, which is what the second round will know.
    """
    some = asked.orderBy(F.xxhash64("__q"), "__q").limit(trials)
    hits, visits, limited = _two_rounds(index, some, k, None)
    early = visits.filter("__early").select("__q", "__cell").distinct().withColumn("__early", F.lit(True))
    found = hits.select("__q", "__cell").join(limited, "__q").join(early, ["__q", "__cell"], "left")
    found = found.select("__cell", "__limit", F.coalesce("__early", F.lit(False)).alias("__early"), "__v").toArrow()
    if not found.num_rows:
        return np.inf
    cell, limit, at_once = (found.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in range(3))
    questions = _matrix(found.column(3).combine_chunks())
    needed = index.cells.cosines(questions, limit[:, None])[np.arange(len(cell)), cell]
    # what the first round visits needs nothing
    needed[at_once.astype(bool)] = -np.inf
    share = min(1.0, recall + 2 * np.sqrt(recall * (1 - recall) / len(needed)))
    return float(np.sort(needed)[min(len(needed) - 1, int(np.ceil(share * len(needed))) - 1)])


def search(
    index: CellIndex,
    questions: DataFrame,
    k: int = 4,
    qid: str = "question_id",
    vid: str = "vec_id",
    question_vector: str = "embedding",
    recall: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``qid, vid, score, rank`` of the nearest vectors, exact unless a ``recall`` is wanted, and the visits made (``__cell, __part, __q``).

    Scores and ranks are those of :func:`ragspark.operators.retrieval.top_k`.
    """
    if k < 1 or recall is not None and not 0 < recall <= 1:
        raise ValueError("k must be positive and recall in (0, 1]")
    asked = _asked(questions, qid, question_vector)
    if not index.cells.sizes.any():
        asked = asked.filter("false")
    cosine = None if recall is None else neighbour_cosine(index, asked, k, recall)
    hits, visits, _ = _two_rounds(index, asked, k, cosine)
    named = hits.select(F.col("__q").alias(qid), F.col("__id").alias(vid), _score(F.col("__cost"), index.cells.metric).alias("score"), "rank")
    return named, visits.drop("__early")


def visit_share(index: CellIndex, visits: DataFrame, questions: int) -> float:
    """Visits made, of those that a search without bounds would make: every question to every slice."""
    return visits.count() / max(1, questions * int(index.cells.parts[index.cells.sizes > 0].sum()))
