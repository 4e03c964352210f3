"""Prefix trie of conversations: every distinct sequence of first turns, with its members, children, leaves and savings.

Method. Identical conversations collapse into one weighted sequence, which carries its weight, its smallest id and, as a digest,
its list of ends. Sequences that are proper prefixes of others are dropped by an anti-join; those left are the
leaves. Prefixes of the weighted sequences are then aggregated: a node is the group of equal prefixes. What a node adds to all nodes
above it is given to one sequence, its owner (that of the node's smallest id), summed from the end of that
sequence and then over all sequences through a node, so a subtree is never walked and no pair of nodes is formed.

A prefix is known by its depth and four sums of 31 bits, over its turns, of hashes of place and SHA-256 of role and text (124 bits in
all). Sums run in parallel: a sequence is cut into blocks of depths, and the totals of a block are all that is carried over. One
conversation, or one prefix, may be a third of all rows: numbering is by ranges (:mod:`ragspark.llm.runs`), joins back to
rows are salted (:mod:`ragspark.operators.hotkeys`), the rest are sums that combine before they are shuffled. Lists of ends are cut into
chunks in parallel; a digest over a list has an order, so one task streams the chunks of a list.

Odd rows: null role or text is empty; turns come in order, nulls first, turns of one number by role and digest of text; a null
conversation id has no decimal form, so its rows are no conversation; an empty table has no node, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.common import written
from ragspark.operators.hotkeys import salted_join
from ragspark.llm.runs import numbered

#: Depths of a block.
BLOCK = 65_536
#: Ids in a chunk of a list of ends.
CHUNK = 8192
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

_SUMS = ["s1", "s2", "s3", "s4"]


def first_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its five."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(9)).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of all conversations, and their turns after rebuilding as ``conv_id, depth, item, size``.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % 5`` (all, if fewer; none, if there is no such one) and goes on with its own turns after
    its first ``h``. ``item`` is a digest of role and text, ``size`` the bytes of the text.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", filled("role").alias("role"), filled("text").alias("text"))
    digest = F.sha2("text", 256)
    light = rows.filter("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        "role",
        digest.alias("digest"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", digest), 256).alias("item"),
        F.octet_length("text").cast("long").alias("size"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    placed = numbered(light, "conv_id", order).select("conv_id", "pos", "item", "size")
    lengths = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    first = F.col("conv_id") - F.col("conv_id") % 5
    ids = lengths.select("conv_id", first_turns(F.col("conv_id")).alias("h"), first.alias("base"))
    bases = lengths.select(F.col("conv_id").alias("base"), "length")
    taken = F.least("h", F.coalesce("length", F.lit(0))).cast("long").alias("taken")
    known = written(ids.join(bases, "base", "left").select("conv_id", "base", "h", taken), "rebuilt")
    h = first_turns(F.col("conv_id"))
    later = salted_join(placed.filter(F.col("pos") >= h), known.select("conv_id", "h", "taken"), ["conv_id"], "inner", F.col("pos"))
    own = later.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "item", "size")
    heads = placed.filter("pos < 8").withColumnRenamed("conv_id", "base")
    given = heads.join(known, "base").filter("pos < taken").select("conv_id", (F.col("pos") + 1).alias("depth"), "item", "size")
    return known.select("conv_id"), own.union(given)


def _key(depth: str, sums: list[Column]) -> Column:
    """Name of a prefix by its depth and sums."""
    return F.concat_ws(".", F.col(depth).cast("string"), *[F.hex(s) for s in sums]).alias("key")


def _marked(items: DataFrame) -> DataFrame:
    """Items with the four parts of the hash of place and item."""
    hashes = [F.xxhash64(F.lit(seed), "depth", "item") for seed in (1, 2)]
    low = F.lit((1 << 31) - 1)
    parts = [p for x in hashes for p in (x.bitwiseAND(low), F.shiftrightunsigned(x, 33))]
    return items.select("conv_id", "depth", "size", *[p.alias(s) for p, s in zip(parts, _SUMS)])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a key, in order, joined in chunks; a chunk may end where a batch ends."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(0)
        changes = np.flatnonzero(pa.compute.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1 if n > 1 else []
        cuts = np.unique(np.concatenate([[0], changes, np.arange(0, n, CHUNK)])).astype(np.int64)
        ids = batch.column(1).to_pylist()
        lists = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, [*cuts[1:], n])]
        columns = [keys.take(pa.array(cuts)), batch.column(1).take(pa.array(cuts)), pa.array(lists, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    for batch in batches:
        out = []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = own, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def end_digests(members: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the ascending, comma-joined ``conv_id`` of each ``key``."""
    ranged = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = ranged.mapInArrow(_chunks, "key string, first long, ids string")
    together = chunks.repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
    return together.mapInArrow(_hashed, "key string, ends_sha256 string")


def _carried(rows: DataFrame, block: int, columns: list[Column], over: list[Column]) -> DataFrame:
    """``rep, blk`` and what ``over`` makes of the totals ``columns`` of a sequence's blocks; only sequences with more than one block have rows."""
    totals = rows.filter(F.col("length") >= block).groupBy("rep", "blk").agg(*columns)
    return totals.select("rep", "blk", *over)


def trie(ids: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``ids`` names each conversation once; ``items`` holds their turns, ``depth`` counting from 1 without gaps.
    """
    marked = written(_marked(items), "items")
    sums = [F.col(s) for s in _SUMS]
    whole = marked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"), *[F.sum(s).alias(s) for s in _SUMS])
    zero = F.lit(0).cast("long")
    named = ids.join(whole, "conv_id", "left").fillna(0, ["length", *_SUMS])
    members = written(named.select("conv_id", "length", _key("length", sums)), "members")
    # identical conversations are one weighted sequence
    weighted = members.groupBy("key", "length").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    sequences = written(weighted, "sequences")
    of_rep = sequences.select(F.col("rep").alias("conv_id"), "length", "weight")
    kept = salted_join(marked, of_rep, ["conv_id"], "inner", F.col("depth")).withColumnRenamed("conv_id", "rep")
    roots = sequences.select("rep", zero.alias("depth"), zero.alias("size"), *[zero.alias(s) for s in _SUMS], "length", "weight")
    steps = kept.select(*roots.columns).union(roots).withColumn("blk", F.floor(F.col("depth") / block).cast("long"))
    steps = written(steps, "steps")

    # prefixes of the weighted sequences
    earlier = Window.partitionBy("rep").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    before = _carried(steps, block, [F.sum(s).alias(s) for s in _SUMS], [F.coalesce(F.sum(s).over(earlier), zero).alias(f"b{s}") for s in _SUMS])
    inside = Window.partitionBy("rep", "blk").orderBy("depth")
    ran = steps.select("rep", "blk", "depth", "size", "length", "weight", *[F.sum(s).over(inside).alias(s) for s in _SUMS])
    summed = ran.join(before, ["rep", "blk"], "left")
    totals = [F.col(s) + F.coalesce(F.col(f"b{s}"), zero) for s in _SUMS]
    prefixes = written(summed.select("rep", "blk", "depth", "size", "length", "weight", _key("depth", totals)), "prefixes")

    # sequences that no other continues are the leaves
    proper = prefixes.filter("depth < length").select("key").distinct()
    leaves = sequences.join(proper, "key", "left_anti").select("key", F.lit(1).cast("long").alias("leaf"))
    nodes = prefixes.groupBy("key").agg(F.sum("weight").alias("n_convs"), F.min("rep").alias("node_conv"))
    nodes = written(nodes.join(leaves, "key", "left"), "nodes")
    rows = salted_join(prefixes, nodes, ["key"], "inner", F.xxhash64("rep"))
    owned = F.col("node_conv") == F.col("rep")
    valued = written(
        rows.select(
            "rep", "blk", "depth", "length", "key", "n_convs", "node_conv", owned.alias("owned"),
            F.when(owned, (F.col("n_convs") - 1) * F.col("size")).otherwise(0).alias("value"),
            F.when(F.col("depth") == F.col("length"), F.coalesce("leaf", zero)).otherwise(0).alias("ends_leaf"),
        ),
        "valued",
    )

    # what a sequence adds to each of its prefixes: its own nodes from there to its end
    by_block = Window.partitionBy("rep").orderBy("blk")
    later = by_block.rowsBetween(1, Window.unboundedFollowing)
    after = _carried(
        valued,
        block,
        [F.sum("value").alias("v"), F.sum("ends_leaf").alias("l"), F.min_by("owned", "depth").alias("o"), F.max_by("node_conv", "depth").alias("c")],
        [F.sum("v").over(later).alias("v"), F.sum("l").over(later).alias("l"), F.lead("o").over(by_block).alias("o"), F.lag("c").over(by_block).alias("c")],
    )
    onward = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    local = valued.select(
        "rep", "blk", "depth", "key", "n_convs", "node_conv",
        F.sum("value").over(onward).alias("adds"),
        F.sum("ends_leaf").over(onward).alias("leaves"),
        F.lead("owned").over(inside).alias("child"),
        F.lag("node_conv").over(inside).alias("parent"),
    )
    full = local.join(after, ["rep", "blk"], "left")
    grouped = full.groupBy("key").agg(
        F.max("node_conv").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max(F.coalesce("parent", "c")).alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"),
        F.sum(F.coalesce("child", "o", F.lit(False)).cast("long")).alias("n_children"),
        F.sum(F.col("leaves") + F.coalesce("l", zero)).alias("n_leaves"),
        F.sum(F.col("adds") + F.coalesce("v", zero)).alias("saved_tokens"),
    )
    return grouped.join(end_digests(members), "key", "left").fillna({"ends_sha256": EMPTY_SHA256}).drop("key")
