"""Exact top-k retrieval, diversified retrieval, context assembly and prompts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("l2", "cosine", "dot")

# Estimated bytes of vectors that one task of the exact search holds.
BLOCK_BYTES = 64 << 20
# Scores held at a time by one task.
_SCORES = 4_000_000
# Significant digits of a cost that decide; what follows depends on the order of summation.
_DIGITS = 12


def _significant(cost: np.ndarray) -> np.ndarray:
    scale = np.ones_like(cost)
    some = np.abs(cost) > 0
    scale[some] = 10.0 ** (_DIGITS - 1 - np.floor(np.log10(np.abs(cost[some]))))
    rounded = np.round(cost * scale) / scale
    return np.where(np.isfinite(rounded), rounded, cost)


def _screen(questions: np.ndarray, vectors: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Costs of all pairs by one product, and how far each question's may be off."""
    products = questions @ vectors.T
    q2 = np.einsum("ij,ij->i", questions, questions)
    v2 = np.einsum("ij,ij->i", vectors, vectors)
    largest = v2.max(initial=0.0)
    if metric == "dot":
        return -products, 1e-12 * np.sqrt(q2 * largest)
    if metric == "l2":
        return q2[:, None] + v2[None, :] - 2 * products, 1e-12 * (q2 + largest)
    norms = np.sqrt(q2)[:, None] * np.sqrt(v2)[None, :]
    cosine = np.divide(products, norms, out=np.zeros_like(products), where=norms > 0)
    return 1.0 - cosine, np.full(len(q2), 1e-11)


def _exact(questions: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Costs of pairs row by row, from differences where the product would cancel."""
    if metric == "dot":
        return _significant(-np.einsum("ij,ij->i", questions, vectors))
    if metric == "l2":
        apart = vectors - questions
        return _significant(np.einsum("ij,ij->i", apart, apart))

    def unit(m: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    q, v = unit(questions), unit(vectors)
    apart = v - q
    both = q.any(axis=1) & v.any(axis=1)
    return np.round(np.where(both, np.einsum("ij,ij->i", apart, apart) / 2, 1.0), _DIGITS)


def _nearest(
    questions: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, metric: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Question, vector and cost of the k cheapest pairs of each question; ties go to the smaller id.

    Pairs that the screening cannot tell from the k-th are costed exactly, so it loses none.
    """
    near_q, near_v, near_cost = [], [], []
    step = max(1, _SCORES // max(1, len(questions)))
    pairs = max(1, _SCORES // max(1, vectors.shape[1]))
    for a in range(0, len(ids), step):
        cost, off = _screen(questions, vectors[a : a + step], metric)
        if cost.shape[1] > k:
            limit = np.partition(cost, k - 1, axis=1)[:, k - 1] + 2 * off
            q, v = np.nonzero(cost <= limit[:, None])
        else:
            q, v = (x.ravel() for x in np.indices(cost.shape))
        for b in range(0, len(q), pairs):
            some_q, some_v = q[b : b + pairs], v[b : b + pairs] + a
            near_q.append(some_q)
            near_v.append(some_v)
            near_cost.append(_exact(questions[some_q], vectors[some_v], metric))
    q, v, cost = np.concatenate(near_q), np.concatenate(near_v), np.concatenate(near_cost)
    order = np.lexsort((ids[v], cost, q))
    place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    order = order[place < k]
    return q[order], v[order], cost[order]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _ids(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _score(cost: Column, metric: str) -> Column:
    if metric == "l2":
        return F.sqrt(cost)
    return -cost if metric == "dot" else 1.0 - cost


def _blocks(vectors: DataFrame, least: int) -> int:
    """Blocks of about ``BLOCK_BYTES`` by the optimizer's estimate, which costs no job; ``least`` where it knows nothing."""
    size = int(vectors._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 60
    return max(least, -(-size // BLOCK_BYTES)) if known else least


def top_k(
    questions: DataFrame,
    vectors: DataFrame,
    k: int = 4,
    qid: str = "question_id",
    vid: str = "vec_id",
    question_vector: str = "embedding",
    vector: str = "embedding",
    metric: str = "l2",
    blocks: int | None = None,
    carry: bool = False,
) -> DataFrame:
    """The ``k`` nearest vectors of each question: ``qid, vid, score, rank``.

    Null vectors are left out, here and not by a filter, which would compute an
    embedding column twice. With ``carry`` the vectors found come along as ``vector``, which saves joining them.
    A question id that is given twice is asked once, with the smaller vector.

    Exact. ``score`` is the distance for ``l2`` and the similarity otherwise. Ranks follow the cost to twelve
    digits (of its own size; of one for ``cosine``), then the vector id.

    One plan for all sizes, and no job while it is built: vectors are shuffled once into ``blocks``, each question goes
    to every block and streams past the vectors that its task holds, and a block returns k rows per question. A task
    holds one block of vectors. Unless given, there are as many blocks as the session has shuffle partitions, and more
    where the optimizer's estimate of the table asks for it, so that a block stays near ``BLOCK_BYTES``.
    :mod:`ragspark.operators.cells` skips blocks instead, for the price of an index.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k < 1:
        raise ValueError("k must be positive")
    session = vectors.sparkSession
    count = blocks or _blocks(vectors, int(session.conf.get("spark.sql.shuffle.partitions")))
    q_field, v_field = questions.schema[qid], vectors.schema[vid]
    schema = T.StructType(
        [
            T.StructField(qid, q_field.dataType),
            T.StructField(vid, v_field.dataType),
            T.StructField("__cost", T.DoubleType()),
        ]
        + ([T.StructField("vector", T.ArrayType(T.FloatType()))] if carry else [])
    )
    as_vector = F.col(vector).cast("array<double>").alias("__v")
    held = vectors.select(
        F.pmod(F.xxhash64(vid), F.lit(count)).cast("int").alias("__block"),
        F.lit(False).alias("__asks"),
        F.lit(None).cast(q_field.dataType).alias("__q"),
        F.col(vid).alias("__id"),
        as_vector,
    )
    once = questions.groupBy(F.col(qid).alias("__q")).agg(F.min(F.col(question_vector).cast("array<double>")).alias("__v"))
    asked = once.select(
        F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("__block"),
        F.lit(True).alias("__asks"),
        "__q",
        F.lit(None).cast(v_field.dataType).alias("__id"),
        "__v",
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, vectors_held, ids = None, [], None, None
        for batch in batches:
            blocks_in = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(blocks_in)) + 1
            for a, b in zip([0, *edges], [*edges, len(blocks_in)]):
                if b == a:
                    continue
                part = batch.slice(a, b - a)
                if blocks_in[a] != block:
                    block, parts, vectors_held = int(blocks_in[a]), [], None
                part = part.filter(part.column(4).is_valid())
                asks = part.column(1).to_numpy(zero_copy_only=False)
                own = int(np.searchsorted(asks, True))
                if own:
                    parts.append((_ids(part.column(3).slice(0, own)), _matrix(part.column(4).slice(0, own))))
                if own == len(part) or not parts:
                    continue
                if vectors_held is None:
                    ids, vectors_held = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                some = part.slice(own)
                q, v, cost = _nearest(_matrix(some.column(4)), vectors_held, ids, k, metric)
                columns = [some.column(2).take(pa.array(q)), pa.array(ids[v].tolist(), type=v_type), pa.array(cost)]
                if carry:
                    columns.append(pa.array(list(vectors_held[v].astype(np.float32)), type=pa.list_(pa.float32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    v_type = to_arrow_type(v_field.dataType)
    found = (
        held.union(asked)
        .repartition(count, "__block")
        .sortWithinPartitions("__block", "__asks")
        .mapInArrow(run, schema)
    )
    order = Window.partitionBy(qid).orderBy("__cost", vid)
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(
            qid, vid, _score(F.col("__cost"), metric).alias("score"), "rank",
            *(["vector"] if carry else []),
        )
    )


def above_score(hits: DataFrame, threshold: float, metric: str = "cosine") -> DataFrame:
    """Keep hits at least as similar as ``threshold``; for ``l2``, at most that far."""
    score = F.col("score")
    return hits.filter(score <= threshold if metric == "l2" else score >= threshold)


def diverse_top_k(
    questions: DataFrame,
    vectors: DataFrame,
    k: int = 4,
    fetch_k: int = 20,
    balance: float = 0.5,
    qid: str = "question_id",
    vid: str = "vec_id",
    question_vector: str = "embedding",
    vector: str = "embedding",
) -> DataFrame:
    """Maximal marginal relevance among the ``fetch_k`` nearest: ``qid, vid, rank``.

    Each step takes the candidate with the largest ``balance * similarity to the
    question - (1 - balance) * largest similarity to those taken``. A group holds
    ``fetch_k`` rows.
    """
    near = top_k(
        questions, vectors, fetch_k, qid, vid, question_vector, vector, "l2", carry=True
    )
    once = questions.groupBy(qid).agg(F.min(F.col(question_vector)).alias("__q"))
    rows = near.join(once, qid)
    schema = T.StructType([near.schema[qid], near.schema[vid], T.StructField("rank", T.IntegerType())])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        taken = _diversify(
            np.asarray(pdf["__q"].iloc[0], dtype=float),
            np.stack(pdf["vector"]).astype(float), k, balance,
        )
        return pdf.iloc[taken][[qid, vid]].assign(rank=np.arange(1, len(taken) + 1))

    return rows.groupBy(qid).applyInPandas(pick, schema)


def _diversify(question: np.ndarray, vectors: np.ndarray, k: int, balance: float) -> list[int]:
    def unit(m: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(m, axis=-1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    v = unit(vectors)
    wanted = v @ unit(question)
    taken = [int(np.argmax(wanted))]
    repeated = v @ v[taken[0]]
    while len(taken) < min(k, len(v)):
        gain = balance * wanted - (1 - balance) * repeated
        gain[taken] = -np.inf
        taken.append(int(np.argmax(gain)))
        repeated = np.maximum(repeated, v @ v[taken[-1]])
    return taken


def assemble_context(
    hits: DataFrame, qid: str = "question_id", text: str = "text", separator: str = "\n\n"
) -> DataFrame:
    """Texts of each question's hits in rank order, as column ``context``; k rows per question."""
    listed = F.sort_array(F.collect_list(F.struct("rank", F.col(text).alias("text"))))
    return hits.groupBy(qid).agg(F.array_join(listed["text"], separator).alias("context"))


def render(template: Column, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` places in one pass; a name without a value is an error, ``{{`` is a brace.

    Values are not searched for places again. The template is cut at its places and
    the parts between are joined, so cost grows with the result.
    """
    place = r"\{\{|\}\}|\{[A-Za-z_][A-Za-z0-9_]*\}"
    parts = F.split(template, place, -1)
    places = F.regexp_extract_all(template, F.lit(place), F.lit(0))

    def value(p: Column) -> Column:
        out = F.when(p == "{{", F.lit("{")).when(p == "}}", F.lit("}"))
        for name, column in values.items():
            out = out.when(p == "{" + name + "}", F.coalesce(column.cast("string"), F.lit("None")))
        return out.otherwise(F.raise_error(F.concat(F.lit("no value for "), p)))

    filled = F.zip_with(
        parts, F.transform(places, value), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))
    )
    return F.array_join(filled, "")
