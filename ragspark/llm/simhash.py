"""SimHash near-duplicates, linked by generalised pigeonhole search.

A fingerprint has a bit set where more than half of the hashed shingles have it. Two fingerprints link when
they differ in at most ``most`` bits. The 64 bits are cut into partitions of bits that vary together; a
partition gets a threshold ``t`` of its own, and the thresholds satisfy ``sum(t + 1) = most + 1``, so a
linked pair differs by at most ``t`` in one partition at least. Thresholds come from dynamic programming
over the expected number of probes and candidates; the statistics behind it are those of all fingerprints.

Documents of one fingerprint are one class from the start (counted before any shuffle of theirs). A
class is written to the bucket of its own key in each partition and to those that lie up to ``t`` flipped
bits above it. Within a bucket all rows are compared and only a spanning forest of the links leaves it,
so a group of near copies costs as many rows as it has members. Buckets that hold too many rows are
cut in blocks, and each pair of blocks is a task of its own.

Null and empty texts have fingerprint zero and link like any other. Repeated rows share a class. A null id
takes part, but does not name a component unless it is alone there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb, exp, lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import map_texts, written
from ragspark.llm.components import components

BITS = 64
SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: Rows of a bucket that one task compares; larger buckets are cut in blocks of about this size.
BLOCK_ROWS = 4096
#: Cost of a candidate comparison, in shuffled probe rows.
CANDIDATE_COST = 0.02

_PAIRS = 1 << 21
_BROADCAST_ROWS = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text; words are cut at ASCII white space, A-Z count as a-z."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    ends = np.zeros(BITS, np.int64)
    join = b" ".join
    count = max(1, len(words) - shingle + 1)
    for start in range(0, count, 1 << 15):
        part = [digest(join(words[i : i + shingle]), SEED) for i in range(start, min(count, start + (1 << 15)))]
        ends += _bits(np.array(part, np.uint64)).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ends > count, bitorder="little").view("<u8")[0])


def _bits(values: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones per value, lowest bit first."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the text replaced by ``fp``, the fingerprint as a signed long."""

    def work(texts: list) -> dict[str, pa.Array]:
        return {"fp": pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))}

    return map_texts(docs, text, lambda: work, "fp long")


def bit_counts(classes: DataFrame) -> np.ndarray:
    """How often two bits are set together, over all rows of ``fp``: a 64 x 64 matrix."""
    rows, columns = np.triu_indices(BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.float64)
        for batch in batches:
            bits = _bits(batch.column("fp").to_numpy().view(np.uint64)).astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows * BITS + columns), pa.array(total[rows, columns].astype(np.int64))], ["cell", "n"]
        )

    got = classes.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((BITS, BITS))
    cells = got.column("cell").to_numpy()
    out[cells // BITS, cells % BITS] = got.column("n").to_numpy()
    return np.maximum(out, out.T)


def grouped_bits(together: np.ndarray, count: int, parts: int) -> list[list[int]]:
    """Cut the bits into ``parts`` nearly equal groups of strongly correlated bits."""
    share = np.diag(together) / max(count, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    tied = np.abs(together / max(count, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(tied, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: tied[b, left].sum())]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: tied[b, group].sum())
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def chance_within(together: np.ndarray, count: int, bits: list[int], most: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0, 1, ... ``most`` of ``bits``.

    The number of differing bits is taken as beta-binomial with the mean and variance that the pairwise
    counts of the corpus give.
    """
    n = max(count, 1)
    p = np.diag(together)[bits] / n
    both = together[np.ix_(bits, bits)] / n
    differ = 2 * p * (1 - p)
    only_a, only_b = p[:, None] - both, p[None] - both
    neither = 1 - p[:, None] - p[None] + both
    joint = 2 * (both * neither + only_a * only_b)
    np.fill_diagonal(joint, differ)
    w, mean = len(bits), max(float(differ.sum()), 1e-6)
    variance = max(float(joint.sum()) - mean * mean, 1e-9)
    q = min(mean / w, 1 - 1e-9)
    tie = (variance / (w * q * (1 - q)) - 1) / max(w - 1, 1)
    if tie < 1e-4:
        each = [comb(w, k) * q**k * (1 - q) ** (w - k) for k in range(most + 1)]
    else:
        scale = 1 / min(tie, 0.99) - 1
        a, b = q * scale, (1 - q) * scale
        beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
        each = [comb(w, k) * exp(beta(k + a, w - k + b) - beta(a, b)) for k in range(most + 1)]
    return np.minimum(np.cumsum(each), 1).tolist()


@dataclass(frozen=True)
class Plan:
    """Partitions of the bits and their thresholds; -1 leaves a partition out."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def plan_search(together: np.ndarray, count: int, most: int = MOST_BITS) -> Plan:
    """The cheapest plan over two to ``most + 1`` partitions."""
    best = None
    for m in range(2, max(2, most + 1) + 1):
        parts = grouped_bits(together, count, m)
        costs = []
        for bits in parts:
            near = chance_within(together, count, bits, most)
            probes = np.cumsum([comb(len(bits), k) for k in range(most + 1)])
            costs.append([0.0] + [count * float(probes[t]) + CANDIDATE_COST * count * (count - 1) / 2 * near[t] for t in range(most + 1)])
        # state: budget spent so far -> (cost, thresholds)
        states = {0: (0.0, ())}
        for own in costs:
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for spent, (cost, chosen) in states.items():
                for step, more in enumerate(own):
                    at = spent + step
                    if at <= most + 1 and (at not in after or cost + more < after[at][0]):
                        after[at] = (cost + more, (*chosen, step - 1))
            states = after
        cost, chosen = states[most + 1]
        if best is None or cost < best.cost:
            best = Plan(tuple(map(tuple, parts)), chosen, cost)
    return best


def _keys(values: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for place, bit in enumerate(bits):
        out |= ((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << place
    return out


def _flips(width: int, most: int) -> list[int]:
    return [sum(1 << b for b in some) for k in range(1, most + 1) for some in combinations(range(width), k)]


_PART_SHIFT = 40  # partitions have 32 bits at most


def postings(classes: DataFrame, plan: Plan) -> DataFrame:
    """Rows ``bucket, fp, probe``: each class in its own bucket and in those above it within the threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column("fp").to_numpy()
            for start in range(0, len(signed), 4096):
                own = signed[start : start + 4096]
                for i, (bits, most) in enumerate(zip(plan.parts, plan.thresholds)):
                    if most < 0:
                        continue
                    keys = _keys(own.view(np.uint64), bits)
                    yield rows(i, keys, own, False)
                    for flip in _flips(len(bits), most):
                        above = (keys ^ flip) > keys
                        if above.any():
                            yield rows(i, keys[above] ^ flip, own[above], True)

    def rows(part: int, keys: np.ndarray, values: np.ndarray, probe: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(keys + (part << _PART_SHIFT)), pa.array(values), pa.array(np.full(len(keys), probe))],
            ["bucket", "fp", "probe"],
        )

    return classes.select("fp").mapInArrow(work, "bucket long, fp long, probe boolean")


def crowded(classes: DataFrame, plan: Plan, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``bucket, blocks`` of the buckets that may hold more rows than one task should compare.

    A bucket is crowded only by classes whose own bucket is: their number is known from counts.
    """
    exact = Plan(plan.parts, tuple(min(t, 0) for t in plan.thresholds), 0.0)
    full = postings(classes, exact).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column("bucket").to_numpy(), batch.column("n").to_numpy()
            for i, (bits, most) in enumerate(zip(plan.parts, plan.thresholds)):
                mine = (at >> _PART_SHIFT) == i
                if most < 0 or not mine.any():
                    continue
                for flip in [0, *_flips(len(bits), most)]:
                    yield pa.RecordBatch.from_arrays([pa.array(at[mine] ^ flip), pa.array(n[mine])], ["bucket", "n"])

    near = full.mapInArrow(around, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return near.select("bucket", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest member) with the same components as the edges ``a, b``."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        after = root.copy()
        np.minimum.at(after, root[u], low)
        np.minimum.at(after, root[v], low)
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, root):
            break
        root = after
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _matched(group: np.ndarray, values: np.ndarray, probe: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forests of the links inside each run of equal ``group``; entries come before probes in a run."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    entries = np.add.reduceat((~probe).astype(np.int64), starts)
    first = np.repeat(starts, sizes)
    rank = np.arange(len(group)) - first
    against = np.minimum(rank, np.repeat(entries, sizes))
    busy = np.flatnonzero(against)
    if not len(busy):
        return
    sums = np.cumsum(against[busy])
    cuts = np.unique(np.searchsorted(sums, np.arange(0, sums[-1], _PAIRS)))
    for lo, hi in zip(cuts, [*cuts[1:], len(busy)]):
        rows = busy[lo:hi]
        if not len(rows):
            continue
        n = against[rows]
        left = np.repeat(rows, n)
        right = np.repeat(first[rows], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        apart = np.bitwise_count(values[left] ^ values[right])
        linked = (apart <= most) & (apart > 0)
        if linked.any():
            yield forest(values[left[linked]].view(np.int64), values[right[linked]].view(np.int64))


def links(classes: DataFrame, most: int = MOST_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b``: a forest with the components of all pairs of ``fp`` that differ in at most ``most`` bits.

    ``classes`` holds distinct values of ``fp`` and is read several times, so it should be a written table.
    """
    count = classes.count()
    plan = plan_search(bit_counts(classes), count, most)
    rows = postings(classes, plan)
    full = written(crowded(classes, plan, block_rows), "crowded")
    busy = full.count()
    if busy:
        at = F.broadcast(full) if busy <= _BROADCAST_ROWS else full
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        rows = (
            rows.join(at, "bucket", "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("own", block)
            .withColumn("other", other)
            .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "probe")
        )
    else:
        rows = rows.select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "probe")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        last = None

        def done(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            bucket, i, j, values, probe = (np.concatenate(x) for x in zip(*parts))
            changes = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            group = np.concatenate([[0], np.cumsum(changes)])
            for a, b in _matched(group, values.view(np.uint64), probe, most):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j", "fp", "probe")]
            ends = (columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]) | (columns[2] != columns[2][-1])
            cut = int(np.flatnonzero(ends)[-1]) + 1 if ends.any() else 0
            key = tuple(int(c[-1]) for c in columns[:3])
            if cut:
                yield from done([*held, [c[:cut] for c in columns]])
                held = []
            elif held and key != last:
                yield from done(held)
                held = []
            held.append([c[cut:] for c in columns])
            last = key
        if held:
            yield from done(held)

    return (
        rows.repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j", "probe")
        .mapInArrow(match, "a long, b long")
    )


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    most: int = MOST_BITS,
    shingle: int = SHINGLE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``doc_id, fp, component_id`` for each row: the smallest id that links reach from it."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = written(fingerprints(chosen, "text", shingle), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes, most, block_rows)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(rooted.join(smallest, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
