"""Best-fit packing of documents into sequences under conflicts.

A bin holds ``capacity`` characters, and no two pieces of one source and no two of one duplicate cluster. A
longer document is cut in pieces of the capacity; its last piece is what remains. Pieces are dealt to
shards by hash, a shard is packed in one task, longest piece first: open bins are kept by residual, each
source and cluster has a bitmap of the bins that carry it, and the search goes from the tightest residual
that fits to the next until a bin without a conflict is found.

A source or cluster with many pieces in a shard (a third of all rows, say) would make that search walk
over all the bins it is in already; for those, the number of bins without it is kept by residual.

A duplicate cluster is the texts that are equal up to case and white space. A column of clusters (near-duplicate
groups, say) makes rows of one value conflict as well; its nulls conflict with nothing.

An empty or null text is one piece of length 0 with a null bin. A null source conflicts with nothing.
Repeated rows are packed each, and conflict as copies of one cluster. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import written

CAPACITY = 8192
#: Bounds of a shard, in characters and pieces; the number of shards follows the input.
SHARD_CHARS = 32_000_000
SHARD_PIECES = 20_000
#: A source or cluster with this share of a shard's pieces gets its own count of free bins.
_FREQUENT = 0.01
_MAX_FREQUENT = 64
_MOST_TASKS = 20_000

_PACKED = "doc_id long, piece int, start long, length long, carried string, bin_id string, position int"


def best_fit(sizes: list[int], conflicts: list[tuple], capacity: int) -> list[int]:
    """Bin of each item, items taken in the given order. An item carries keys that a bin may hold once.

    The chosen bin is the one of least residual that fits and shares no key with the item; among equals
    the one opened first. An item that fits nowhere opens a bin.
    """
    often = Counter(k for keys in conflicts for k in keys)
    least = max(32, _FREQUENT * len(sizes))
    frequent = {k: i for i, (k, n) in enumerate(often.most_common(_MAX_FREQUENT)) if n >= least}
    free = np.zeros((len(frequent) + 1, capacity + 1), np.int32)  # last row: all bins
    without: list[np.ndarray] = []  # per bin: rows of ``free`` that count it
    at: dict[int, int] = {}  # residual -> bitmap of its bins
    carrying: dict[object, int] = {}  # key -> bitmap of bins
    residual: list[int] = []
    out = []
    for size, keys in zip(sizes, conflicts):
        watched = [frequent[k] for k in keys if k in frequent] or [-1]
        fits = free[watched[0], size:] > 0
        for row in watched[1:]:
            fits &= free[row, size:] > 0
        banned = 0
        for k in keys:
            banned |= carrying.get(k, 0)
        chosen = -1
        level = int(fits.argmax()) if len(fits) else 0
        while level < len(fits) and fits[level]:
            open_here = at[level + size] & ~banned
            if open_here:
                chosen = (open_here & -open_here).bit_length() - 1
                break
            rest = fits[level + 1 :]
            step = int(rest.argmax()) if len(rest) else 0
            if not len(rest) or not rest[step]:
                break
            level += 1 + step
        if chosen < 0:
            chosen = len(residual)
            residual.append(capacity)
            without.append(np.ones(len(frequent) + 1, bool))
        else:
            free[without[chosen], residual[chosen]] -= 1
            at[residual[chosen]] ^= 1 << chosen
        residual[chosen] -= size
        for k in keys:
            carrying[k] = carrying.get(k, 0) | 1 << chosen
            if k in frequent:
                without[chosen][frequent[k]] = False
        free[without[chosen], residual[chosen]] += 1
        at[residual[chosen]] = at.get(residual[chosen], 0) | 1 << chosen
        out.append(chosen)
    return out


def pieces(docs: DataFrame, doc_id: str, text: str, source: str, capacity: int, cluster: str | None = None, carry: str | None = None) -> DataFrame:
    """``doc_id, source, cluster, group, carried, piece, start, length``: a row per piece of at most ``capacity`` characters."""
    text_or_null = lambda name: F.lit(None).cast("string") if name is None else F.col(name).cast("string")
    body = F.coalesce(F.col(text), F.lit(""))
    copies = F.xxhash64(F.lower(F.trim(F.regexp_replace(body, r"\s+", " "))))
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), copies.alias("cluster"),
        text_or_null(cluster).alias("group"), text_or_null(carry).alias("carried"), F.char_length(body).cast("long").alias("chars"),
    )
    return sized.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("chars") / capacity).cast("int") - 1, F.lit(0)))).alias("piece")).select(
        "doc_id", "source", "cluster", "group", "carried", "piece",
        (F.col("piece").cast("long") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("chars") - F.col("piece").cast("long") * capacity).alias("length"),
    )


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    capacity: int = CAPACITY,
    shard_chars: int = SHARD_CHARS,
    shard_pieces: int = SHARD_PIECES,
    cluster: str | None = None,
    carry: str | None = None,
) -> DataFrame:
    """``doc_id, piece, start, length, bin_id, position`` of every piece; ``position`` counts from 0 in a bin.

    ``cluster`` names a column of further clusters; the column ``carry`` is added to the result, as a string.
    """
    items = written(pieces(docs, doc_id, text, source, capacity, cluster, carry), "pieces")
    total = items.filter("length > 0").agg(F.sum("length").alias("chars"), F.count(F.lit(1)).alias("n")).collect()[0]
    shards = max(1, -(-(total["chars"] or 0) // shard_chars), -(-total["n"] // shard_pieces))
    dealt = items.filter("length > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)))

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = group.column("length").to_pylist()
        sources, clusters = group.column("source").to_pylist(), group.column("cluster").to_pylist()
        groups = group.column("group").to_pylist()
        keys = [((s,) if s is not None else ()) + (c,) + ((("group", g),) if g is not None else ()) for s, c, g in zip(sources, clusters, groups)]
        bins = best_fit(sizes, keys, capacity)
        shard = group.column("shard")[0].as_py()
        places, held = [], Counter()
        for b in bins:
            places.append(held[b])
            held[b] += 1
        return group.select(["doc_id", "piece", "start", "length", "carried"]).append_column("bin_id", pa.array([f"{shard}-{b}" for b in bins])).append_column(
            "position", pa.array(places, pa.int32())
        )

    # a shard is few bytes but seconds of work, so Spark must not put shards together by their size
    packed = dealt.repartition(min(shards, _MOST_TASKS), "shard").groupBy("shard").applyInArrow(one, _PACKED)
    empty = items.filter("length = 0").select("doc_id", "piece", "start", "length", "carried", F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("int").alias("position"))
    done = packed.unionByName(empty)
    return done.drop("carried") if carry is None else done.withColumnRenamed("carried", carry)
