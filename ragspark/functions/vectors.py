"""Vector columns: the built-in embedding, and similarity of pairs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ragspark.functions import text as tx
from ragspark.functions.arrays import bind

Embedder = Callable[[list[str]], np.ndarray]

DIMENSION = 64
_WORDS = re.compile(r"\w+")
# Words whose buckets are remembered, words of texts that are held as numbers at a time, and texts that are taken out of an Arrow batch at a time.
_KEPT = 100_000
_WORDS_HELD = 100_000
_TEXTS_HELD = 256


class HashedWords:
    """Counts of lower-cased words in ``dim`` buckets; a bucket is the head of md5 modulo ``dim``.

    A stand-in for a hosted model: it needs no network and gives the same vector
    everywhere. Any callable from a list of texts to a matrix may replace it.
    """

    def __init__(self, dim: int = DIMENSION) -> None:
        self.dim = dim
        self._bucket: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {"dim": self.dim, "_bucket": {}}

    def __call__(self, texts: list[str]) -> np.ndarray:
        counts = np.zeros((len(texts), self.dim))
        bucket, rows, cols, first = self._bucket, [], [], 0

        def add(last: int) -> None:
            flat = np.repeat(np.arange(last - first), rows) * self.dim + np.asarray(cols, dtype=np.int64)
            counts[first:last] = np.bincount(flat, minlength=(last - first) * self.dim).reshape(-1, self.dim)
            rows.clear()
            cols.clear()

        for row, text in enumerate(texts):
            words = _WORDS.findall((text or "").lower())
            if len(bucket) > _KEPT:
                bucket.clear()
            for word in words:
                if word not in bucket:
                    bucket[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim
            cols.extend(map(bucket.__getitem__, words))
            rows.append(len(words))
            if len(cols) > _WORDS_HELD:
                add(row + 1)
                first = row + 1
        if rows:
            add(len(texts))
        return counts


def by_slices(column: pa.Array, make: Callable[[list], list], kind: pa.DataType) -> pa.Array:
    """What ``make`` returns for the values of an Arrow column; few of them are Python objects at a time, however many rows a batch has."""
    parts = [pa.array(make(column.slice(i, _TEXTS_HELD).to_pylist()), kind) for i in range(0, len(column), _TEXTS_HELD)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def embed(text: Column, embedder: Embedder | None = None) -> Column:
    """Vector of a text as ``array<float>``; null text gives null.

    The embedder is unpacked once per task, so a model is loaded once there.
    """
    model = embedder or HashedWords()

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield by_slices(batch, vectors, pa.list_(pa.float32()))

    def vectors(texts: list[str | None]) -> list[np.ndarray | None]:
        given = [t for t in texts if t is not None]
        made = iter(np.asarray(model(given), dtype=np.float32) if given else ())
        return [None if t is None else next(made) for t in texts]

    return run(text)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors; 0.0 if one is null or has no length."""

    def of(v: Column) -> Column:
        norm = F.sqrt(v["l"]) * F.sqrt(v["r"])
        return F.when(norm > 0, v["d"] / norm).otherwise(0.0)

    parts = F.struct(
        dot(left, left).alias("l"), dot(right, right).alias("r"), dot(left, right).alias("d")
    )
    return F.coalesce(bind(parts, of), F.lit(0.0))


def embedded_similarity(left: Column, right: Column, embedder: Embedder | None = None) -> Column:
    """Similarity of two texts by their vectors; 0.0 if either is empty."""
    return F.when(tx.is_blank(left) | tx.is_blank(right), 0.0).otherwise(
        cosine(embed(left, embedder), embed(right, embedder))
    )
