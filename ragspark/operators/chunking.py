"""Cutting documents into chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.arrays import bind, empty_array, explode_rows
from ragspark.functions.patterns import SPACE
from ragspark.functions.vectors import Embedder, HashedWords, by_slices

SEPARATORS = ["\n\n", "\n", " ", ""]
_MARK = "\x01"


def _explode_chunks(df: DataFrame, chunks: Column, text: str) -> DataFrame:
    others = [c for c in df.columns if c != text]
    return explode_rows(df, others, chunks, text, "chunk_no")


def fixed_chunks(
    df: DataFrame, text: str = "text", chunk_size: int = 1000, chunk_overlap: int = 200
) -> DataFrame:
    """Windows of ``chunk_size`` characters, each starting ``size - overlap`` after the last."""
    _check(chunk_size, chunk_overlap)
    step = chunk_size - chunk_overlap
    size = F.char_length(text)
    last = F.floor(F.greatest(size - chunk_overlap - 1, F.lit(0)) / step).cast("int")
    per_block = F.ceil(F.sqrt(last + 1)).cast("int")

    def windows(w: Column) -> Column:
        """Cut blocks of windows first: each cut walks its text from the start."""

        def block(i: Column) -> Column:
            first = i * w
            part = F.substring(F.col(text), first * step + 1, w * step + chunk_overlap)
            inside = F.sequence(F.lit(0), F.least(w - 1, last - first))
            return bind(
                part,
                lambda p: F.transform(
                    inside, lambda j: F.substring(p, j * step + 1, F.lit(chunk_size))
                ),
            )

        blocks = F.sequence(F.lit(0), F.floor(last / w).cast("int"))
        return F.flatten(F.transform(blocks, block))

    return _explode_chunks(df.filter(size > 0), bind(per_block, windows), text)


def _check(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("need chunk_size > chunk_overlap >= 0")


def _cut(text: str, separator: str) -> list[str]:
    """Pieces that each start with the separator, but for the first."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join pieces up to ``size``; a new chunk begins with the tail of the last, up to ``overlap``."""
    held: deque[str] = deque()
    length = 0
    for piece in pieces:
        if held and length + len(piece) > size:
            yield "".join(held)
            while length > overlap or (length and length + len(piece) > size):
                length -= len(held.popleft())
        held.append(piece)
        length += len(piece)
    if held:
        yield "".join(held)


def _recursive(text: str, separators: list[str], size: int, overlap: int) -> Iterator[str]:
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    finer = separators[at + 1 :]
    small: list[str] = []
    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        yield from _pack(small, size, overlap)
        small = []
        if finer:
            yield from _recursive(piece, finer, size, overlap)
        else:
            yield piece
    yield from _pack(small, size, overlap)


def recursive_chunks(
    df: DataFrame,
    text: str = "text",
    chunk_size: int = 1000,
    chunk_overlap: int = 200,
    separators: list[str] | None = None,
) -> DataFrame:
    """Cut at paragraphs, else lines, else words, else characters, and pack with overlap.

    The rule looks back at what it has already packed, which no built-in expresses,
    so the text alone crosses to Python; other columns stay on the JVM, and no
    row leaves its partition.
    """
    _check(chunk_size, chunk_overlap)
    order = list(SEPARATORS if separators is None else separators)
    if order[-1] != "":
        order.append("")

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [c for c in (p.strip() for p in _recursive(t, order, chunk_size, chunk_overlap)) if c]
                if t
                else []
                for t in texts
            ]
        )

    return _explode_chunks(df, split(F.col(text)), text)


def sentence_parts(text: Column) -> Column:
    """Sentences ending in ``.?!`` before white space, ends kept."""
    return F.split(text, rf"(?<=[.?!])[{SPACE}]+", -1)


def neighbour_distances(sentences: Column, embedder: Embedder | None = None) -> Column:
    """Cosine distances of adjacent sentences, each embedded with its two neighbours."""
    model = embedder or HashedWords()

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield by_slices(batch, lambda rows: [_distances(r, model) for r in rows], pa.list_(pa.float64()))

    return run(sentences)


def _distances(parts: list[str] | None, model: Embedder) -> list[float]:
    if parts is None or len(parts) < 2:
        return []
    windows = [" ".join(parts[max(i - 1, 0) : i + 2]) for i in range(len(parts))]
    vectors = np.asarray(model(windows), dtype=float)
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    dots = np.einsum("ij,ij->i", vectors[:-1], vectors[1:])
    scale = norms[:-1] * norms[1:]
    cosine = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
    return (1.0 - cosine).tolist()


def _quantile(ordered: Column, q: float) -> Column:
    """Linear-interpolated quantile of a sorted, non-empty array."""
    return bind(
        (F.size(ordered) - 1) * F.lit(float(q)),
        lambda h: bind(
            F.struct(
                F.get(ordered, F.floor(h).cast("int")).alias("lo"),
                F.get(ordered, F.ceil(h).cast("int")).alias("hi"),
                (h - F.floor(h)).alias("w"),
            ),
            lambda s: s["lo"] + (s["hi"] - s["lo"]) * s["w"],
        ),
    )


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _gradient(values: Column) -> Column:
    last = F.size(values) - 1
    return F.transform(
        values,
        lambda v, i: (F.get(values, F.least(i + 1, last)) - F.get(values, F.greatest(i - 1, F.lit(0))))
        / F.when((i == 0) | (i == last), 1.0).otherwise(2.0),
    )


# Amount per threshold type.
BREAKPOINTS = {"percentile": 95, "standard_deviation": 3, "interquartile": 1.5, "gradient": 95}


def _breaks(distances: Column, kind: str, amount: float) -> Column:
    """Zero-based sentences after which a chunk ends."""

    def above(values: Column, limit: Column) -> Column:
        marked = F.transform(values, lambda v, i: F.when(v > limit, i.cast("int")))
        return F.filter(marked, lambda i: i.isNotNull())

    def by(values: Column) -> Column:
        ordered = F.sort_array(values)
        if kind in ("percentile", "gradient"):
            limit = bind(ordered, lambda o: _quantile(o, amount / 100))
        elif kind == "standard_deviation":
            limit = bind(
                _mean(values),
                lambda m: m
                + F.sqrt(_mean(F.transform(values, lambda v: (v - m) * (v - m)))) * F.lit(float(amount)),
            )
        else:
            limit = bind(
                ordered,
                lambda o: _mean(values)
                + (_quantile(o, 0.75) - _quantile(o, 0.25)) * F.lit(float(amount)),
            )
        return bind(limit, lambda t: above(values, t))

    series = _gradient(distances) if kind == "gradient" else distances
    enough = F.size(distances) >= (2 if kind == "gradient" else 1)
    return F.when(enough, bind(series, by)).otherwise(empty_array("int"))


def semantic_chunks(
    df: DataFrame,
    text: str = "text",
    threshold_type: str = "percentile",
    amount: float | None = None,
    embedder: Embedder | None = None,
) -> DataFrame:
    """End a chunk where adjacent sentences are further apart than the document's own threshold.

    A document is one row throughout: sentences, thresholds and joining are array
    expressions and only the vectors are made in Python, so nothing is shuffled.
    """
    if threshold_type not in BREAKPOINTS:
        raise ValueError(f"threshold_type must be one of {sorted(BREAKPOINTS)}")
    amount = BREAKPOINTS[threshold_type] if amount is None else amount
    others = [c for c in df.columns if c != text]
    parts = df.filter(F.char_length(text) > 0).select(
        *others, sentence_parts(F.col(text)).alias("__parts")
    )
    measured = parts.withColumn("__distances", neighbour_distances(F.col("__parts"), embedder))
    cut = measured.withColumn(
        "__ends",
        F.concat(
            _breaks(F.col("__distances"), threshold_type, amount), F.array(F.size("__parts") - 1)
        ),
    )
    chunks = F.transform(
        F.col("__ends"),
        lambda e, i: F.array_join(
            F.slice(
                F.col("__parts"),
                F.coalesce(F.get(F.col("__ends"), i - 1), F.lit(-1)) + 2,
                e - F.coalesce(F.get(F.col("__ends"), i - 1), F.lit(-1)),
            ),
            " ",
        ),
    )
    return explode_rows(cut, others, chunks, text, "chunk_no")
