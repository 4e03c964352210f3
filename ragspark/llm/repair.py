"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. Each turn is kept (0), given the role
user or assistant (1) or deleted (2; blank and duplicate turns must be), an empty turn of user or assistant may be put anywhere
(5), and a truncated turn that stays costs 5. The audit is the string of the edits' initials, and of all cheapest edits those
whose audit comes first in ASCII order (D, I, K, R) are made.

Method. What may follow depends only on one of four states (start, after system, after user, after assistant), so a
turn is a step between two layers of four nodes. A dynamic programme from the end gives each node its cost to go, and the steps
that keep to it are the optimal arcs. Arcs are ranked by the first letter of their audits, then by the first two,
four, eight and so on: an arc's rank at twice the length is that of the pair (its rank, the rank of the arc that its pointer
reaches after that length), and pointers double along. No two optimal arcs of a node share a letter, so a node's least arc is known
from the first round on and its pointer is one arc, not a set. The arc of least rank leaves the start, and the doubled pointers
list its path, all positions of a round at once.

Conversations of any length are cut into blocks of turns, since costs of a block are a 4 x 4 table from the state
before to the state after it: blocks are measured in parallel, folded from the end (the cost to go at each end of a block),
asked for the state in which they end for each state in which they begin, and folded from the start. A fold streams one small row a
block. Within a block an insertion stands before the turn it precedes, so audits of a block end alike
and the least audit of a conversation is made of the least audits of its blocks. Texts travel once, in the order of the conversation, to
meet their audit; they are streamed, never held together.

Odd rows: null roles and texts count as one space. Turns come in order, nulls first, turns with one number by role and digest
of text. A role that is empty or has another initial cannot be kept. Null conversation ids are one conversation. Equal
rows are duplicates of the first. An empty table gives empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import written
from ragspark.operators.hotkeys import salted_join
from ragspark.llm.runs import numbered

RETYPE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Turns of a block; codes of a block are one letter a turn.
BLOCK = 65_536
#: Turns whose arcs are ranked together.
SLICE = 100_000
LETTERS = np.frombuffer(b"\0DIKR", dtype=np.uint8)

_FAR = 1 << 40
#: State after a turn is kept, by initial (s, u, a, other) and state (start, after s, after u, after a); 4: not possible.
_KEEP = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: State after a user or assistant turn, whichever may follow.
_NEXT = np.array([2, 2, 3, 2])
#: Turns as letters: small ones may stay, capitals are truncated, digits must go.
_CODES = "suaxSUAX0123"
#: Costs to go after the last turn, insertions included.
END = (0, 2 * INSERT, INSERT, 0)

_ID = "__conv"
_SPACES = " \t\n\x0b\f\r"


def _closed(base: np.ndarray) -> np.ndarray:
    """Costs to go with insertions before the turn."""
    t = base.copy()
    t[:, 2] = np.minimum(base[:, 2], base[:, 3] + INSERT)
    t[:, 3] = np.minimum(base[:, 3], base[:, 2] + INSERT)
    t[:, 0] = np.minimum(base[:, 0], t[:, 2] + INSERT)
    t[:, 1] = np.minimum(base[:, 1], t[:, 2] + INSERT)
    return t


class Layers:
    """Costs to go of several sequences of codes at once: a layer of four nodes before each turn and one after the last."""

    def __init__(self, codes: list[str], ends: np.ndarray, whole: np.ndarray):
        """``ends`` are the costs to go after each sequence; where ``whole``, insertions may follow the last turn."""
        self.sizes = np.array([len(c) for c in codes], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1]
        self.count = int(self.sizes.sum()) + len(codes)
        kinds = np.full(self.count, -1, dtype=np.int64)
        table = np.zeros(128, dtype=np.int64)
        table[np.frombuffer(_CODES.encode(), dtype=np.uint8)] = np.arange(len(_CODES))
        joined = table[np.frombuffer("".join(codes).encode(), dtype=np.uint8)]
        places = np.arange(len(joined)) + np.repeat(np.arange(len(codes)), self.sizes)
        kinds[places] = joined
        self.kinds = kinds
        self.last = self.first + self.sizes
        self.togo = np.full((self.count, 4), _FAR, dtype=np.int64)
        self.togo[self.last] = ends
        self.whole = whole
        by_size = np.argsort(-self.sizes, kind="stable")
        for back in range(1, int(self.sizes.max(initial=0)) + 1):
            live = by_size[: np.searchsorted(-self.sizes[by_size], -back, side="right")]
            at = self.last[live] - back
            delete, keep, retype = self._steps(at)
            self.togo[at] = _closed(np.minimum(np.minimum(delete, keep), retype))

    def _steps(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs of deleting, keeping and retyping the turns of layers ``at``, from each state to the end."""
        after = self.togo[at + 1]
        kind = self.kinds[at]
        stays = np.where(kind < 8, np.where(kind >= 4, CUT, 0), _FAR)[:, None]
        padded = np.concatenate([after, np.full((len(at), 1), _FAR)], axis=1)
        keep = np.take_along_axis(padded, _KEEP[kind % 4], axis=1) + stays
        return after + DELETE, keep, after[:, _NEXT] + RETYPE + stays

    def arcs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Source node, letter and target node of all optimal arcs, by source and letter; a node is 4 x layer + state.

        A node at which an audit ends has one arc, without a letter, to itself.
        """
        layer = np.arange(self.count)
        last = np.zeros(self.count, dtype=bool)
        last[self.last] = True
        at = layer[~last]
        found = []

        def add(layers: np.ndarray, cost: np.ndarray, letter: int, target: np.ndarray) -> None:
            i, q = np.nonzero((cost == self.togo[layers]) & (cost < _FAR))
            found.append((4 * layers[i] + q, np.full(len(i), letter), target[i, q]))

        if len(at):
            delete, keep, retype = self._steps(at)
            below = 4 * (at + 1)[:, None]
            add(at, delete, 1, below + np.arange(4))
            add(at, keep, 3, below + _KEEP[self.kinds[at] % 4])
            add(at, retype, 4, below + _NEXT)
        inserts = np.concatenate([at, self.last[self.whole]])
        add(inserts, self.togo[inserts][:, _NEXT] + INSERT, 2, 4 * inserts[:, None] + _NEXT)
        ends = np.concatenate([4 * self.last[self.whole][:, None] + [0, 3], 4 * self.last[~self.whole][:, None] + [0, 3]]).ravel()
        ends = np.concatenate([ends, (4 * self.last[~self.whole][:, None] + [1, 2]).ravel()])
        found.append((ends, np.zeros(len(ends), dtype=np.int64), ends))
        source, letter, target = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((letter, source))
        return source[order], letter[order], target[order]


def least_audits(layers: Layers, entry: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The least audit of each sequence from the state ``entry``, and the state in which it ends."""
    source, letter, target = layers.arcs()
    nodes, lead = np.unique(source, return_index=True)
    leads = np.full(4 * layers.count, -1, dtype=np.int64)
    leads[nodes] = lead
    # arcs to nodes from which no audit ends are not optimal, so every target has a lead
    pointer, rank, doubled = leads[target], letter, []
    while True:
        doubled.append(pointer)
        pairs = rank * (int(rank.max(initial=0)) + 1) + rank[pointer]
        rank = np.unique(pairs, return_inverse=True)[1]
        if not letter[pointer].any():
            break
        pointer = pointer[pointer]
    # the arc of least rank leaves each node
    by_rank = np.lexsort((rank, source))
    best = np.full(4 * layers.count, -1, dtype=np.int64)
    best[nodes] = by_rank[np.unique(source[by_rank], return_index=True)[1]]
    start = best[4 * layers.first + entry]
    audits: list[str] = [""] * len(start)
    final = np.zeros(len(start), dtype=np.int64)
    # sequences of like length together, so that padding is at most twice their length
    classes = np.ceil(np.log2(layers.sizes + 1)).astype(int)
    for size in np.unique(classes):
        some = np.flatnonzero(classes == size)
        path = start[some][:, None]
        for step in doubled:
            if not letter[path[:, -1]].any():
                break
            path = np.concatenate([path, step[path]], axis=1)
        shown = LETTERS[letter[path]]
        lengths = (shown != 0).sum(axis=1)
        final[some] = target[path[:, -1]] % 4
        for i, row, n in zip(some, shown, lengths):
            audits[i] = row[:n].tobytes().decode()
    return audits, final


def _slices(codes: list[str]) -> Iterator[slice]:
    start, held = 0, 0
    for i, c in enumerate(codes):
        if held and held + len(c) > SLICE:
            yield slice(start, i)
            start, held = i, 0
        held += len(c) + 1
    if start < len(codes):
        yield slice(start, len(codes))


def _illegal(code: str, before: str) -> int:
    """Adjacent initials, that of the turn before the block included, that are not su, ua or au."""
    initials = [_CODES.index(c) % 4 for c in before + code]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:]))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit, cost and misplaced turns of blocks whose entry and cost to go are known."""
    names = [_ID, "block", "audit", "cost", "illegal"]
    for batch in batches:
        codes = batch.column("codes").to_pylist()
        entry = batch.column("entry").to_numpy()
        ends = np.array(batch.column("ends").to_pylist(), dtype=np.int64).reshape(-1, 4)
        whole = batch.column("whole").to_numpy(zero_copy_only=False)
        before = batch.column("before").to_pylist()
        for part in _slices(codes):
            layers = Layers(codes[part], ends[part], whole[part])
            audits, final = least_audits(layers, entry[part])
            n = np.arange(len(audits))
            cost = layers.togo[layers.first, entry[part]] - np.where(whole[part], 0, ends[part][n, final])
            illegal = [_illegal(c, b) for c, b in zip(codes[part], before[part])]
            columns = [batch.column(c).slice(part.start, len(audits)) for c in (_ID, "block")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(audits), pa.array(cost), pa.array(illegal, pa.int64())], names=names)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs of a block from each state before it to each after it."""
    for batch in batches:
        codes = batch.column("codes").to_pylist()
        costs = []
        for code in codes:
            ends = np.full((4, 4), _FAR)
            np.fill_diagonal(ends, 0)
            layers = Layers([code] * 4, ends, np.zeros(4, dtype=bool))
            costs.append(layers.togo[layers.first].T.ravel().tolist())
        columns = [batch.column(_ID), batch.column("block"), pa.array(costs, pa.list_(pa.int64())), pa.array([c[-1] for c in codes])]
        yield pa.RecordBatch.from_arrays(columns, names=[_ID, "block", "costs", "tail"])


def _fold_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost to go after each block; blocks come from the last to the first of a conversation."""
    last, ends = None, None
    for batch in batches:
        out, whole = [], []
        for conv, costs in zip(batch.column(_ID).to_pylist(), batch.column("costs").to_pylist()):
            whole.append(conv != last)
            if conv != last:
                last, ends = conv, np.array(END)
            out.append(ends.tolist())
            ends = np.minimum((np.array(costs).reshape(4, 4) + ends).min(axis=1), _FAR)
        columns = [batch.column(_ID), batch.column("block"), pa.array(out, pa.list_(pa.int64())), pa.array(whole), batch.column("tail")]
        yield pa.RecordBatch.from_arrays(columns, names=[_ID, "block", "ends", "whole", "tail"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after a block's least audit, for each state before it."""
    for batch in batches:
        found = []
        for code, ends, whole in zip(*(batch.column(c).to_pylist() for c in ("codes", "ends", "whole"))):
            layers = Layers([code], np.array([ends]), np.array([whole]))
            known = [q for q in range(4) if layers.togo[0, q] < _FAR]
            exits = dict(zip(known, (int(least_audits(layers, np.array([q]))[1][0]) for q in known)))
            found.append([exits.get(q, 0) for q in range(4)])
        columns = [batch.column(_ID), batch.column("block"), pa.array(found, pa.list_(pa.int64())), batch.column("tail")]
        yield pa.RecordBatch.from_arrays(columns, names=[_ID, "block", "exits", "tail"])


def _fold_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state and the last turn before each block; blocks come in order."""
    last, state, tail = None, 0, ""
    for batch in batches:
        entry, before = [], []
        for conv, exits, own in zip(*(batch.column(c).to_pylist() for c in (_ID, "exits", "tail"))):
            if conv != last:
                last, state, tail = conv, 0, ""
            entry.append(state)
            before.append(tail)
            state, tail = exits[state], own
        columns = [batch.column(_ID), batch.column("block"), pa.array(entry, pa.int64()), pa.array(before)]
        yield pa.RecordBatch.from_arrays(columns, names=[_ID, "block", "entry", "before"])


def _edited(turn_type: pa.DataType):
    """Texts in the order of their conversation, each audit before its turns, become the turns of the repaired conversation."""
    kinds = [pa.string(), pa.int64(), pa.string(), turn_type, pa.string(), pa.string()]
    roles = {2: "user", 3: "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, seq, letters, out = None, 0, 0, deque(), []

        def inserts() -> None:
            nonlocal state, seq
            while letters and letters[0] == "I":
                letters.popleft()
                state = int(_NEXT[state])
                out.append((conv, seq, "I", None, roles[state], ""))
                seq += 1

        def batch_of_rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[_ID, "seq", "edit", "turn", "role", "text"])

        for batch in batches:
            for own, audit, turn, role, text in zip(*(batch.column(c).to_pylist() for c in (_ID, "audit", "turn", "role", "text"))):
                if own != conv:
                    inserts()
                    conv, state, seq = own, 0, 0
                if audit is not None:
                    letters.extend(audit)
                    continue
                inserts()
                edit = letters.popleft()
                if edit == "D":
                    continue
                if edit == "K":
                    state = int(_KEEP["sua".index(role[0]), state])
                else:
                    state = int(_NEXT[state])
                    role = roles[state]
                out.append((conv, seq, edit, turn, role, text))
                seq += 1
            if out:
                yield batch_of_rows()
                out.clear()
        inserts()
        if out:
            yield batch_of_rows()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, digest, out = None, None, []
    for batch in batches:
        for own, role, text in zip(*(batch.column(c).to_pylist() for c in (_ID, "role", "text"))):
            if own != conv:
                if conv is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = own, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=[_ID, "repaired_sha256"])
            out = []
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], names=[_ID, "repaired_sha256"])


def _key(conv_id: str) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def _chained(blocks: DataFrame) -> DataFrame:
    """``entry, ends, whole, before`` of blocks of conversations with more than one."""
    by_conv = lambda frame, order: frame.repartition(_ID).sortWithinPartitions(_ID, order)
    costs = blocks.select(_ID, "block", "codes").mapInArrow(_tables, f"{_ID} string, block long, costs array<long>, tail string")
    schema = f"{_ID} string, block long, ends array<long>, whole boolean, tail string"
    ends = written(by_conv(costs, F.col("block").desc()).mapInArrow(_fold_back, schema), "ends")
    asked = blocks.select(_ID, "block", "codes").join(ends, [_ID, "block"])
    exits = asked.mapInArrow(_exits, f"{_ID} string, block long, exits array<long>, tail string")
    entries = by_conv(exits, F.col("block")).mapInArrow(_fold_on, f"{_ID} string, block long, entry long, before string")
    return ends.drop("tail").join(entries, [_ID, "block"])


def repair(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """A summary row for each conversation, and the turns of the repaired conversations.

    The summary holds ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``; a turn has the first fault that fits.
    The turns are ``conv_id, seq, edit, turn, role, text``, in order within tasks (see :func:`digests`); inserted ones have a null ``turn``.
    """
    id_type, turn_field = turns.schema[conv_id].dataType, turns.schema[turn]
    filled = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(_key(conv_id).alias(_ID), F.col(turn).alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    shown = F.rtrim("text", F.lit(_SPACES))
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)) * (F.col("role") != "").cast("int"), F.lit(0)), F.lit(4)) - 1
    light = rows.select(
        _ID,
        "turn",
        "role",
        "digest",
        initial.alias("initial"),
        (shown == "").alias("blank"),
        (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    placed = numbered(light, _ID, [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()])
    same = [_ID, "role", "digest"]
    firsts = placed.groupBy(*same).agg(F.min("pos").alias("first"))
    known = salted_join(placed, firsts, same, "inner", F.col("pos")).withColumn("duplicate", ~F.col("blank") & (F.col("pos") > F.col("first")))
    gone = F.col("blank") | F.col("duplicate")
    kind = F.when(gone, 8).when(F.col("cut"), 4).otherwise(0) + F.col("initial")
    marked = written(
        known.select(
            _ID, "turn", "role", "digest", "pos", "blank", "duplicate", (F.col("cut") & ~gone).alias("truncated"),
            F.substring(F.lit(_CODES), kind + 1, F.lit(1)).alias("code"),
        ),
        "marked",
    )
    counted = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    faults = marked.groupBy(_ID, "turn").agg(*[counted(c) for c in ("blank", "duplicate", "truncated")])
    span = (F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long")
    faults = faults.groupBy(_ID).agg(F.coalesce(span, F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])

    number = F.floor(F.col("pos") / block).cast("long").alias("block")
    listed = F.sort_array(F.collect_list(F.struct("pos", "code")))
    blocks = written(marked.groupBy(_ID, number).agg(F.array_join(F.transform(listed, lambda x: x["code"]), "").alias("codes")), "blocks")
    alone = (F.col("block") == 0) & (F.length("codes") < block)
    single = blocks.filter(alone).select(
        "*", F.lit(0).cast("long").alias("entry"), F.array(*[F.lit(c).cast("long") for c in END]).alias("ends"), F.lit(True).alias("whole"), F.lit("").alias("before")
    )
    several = blocks.filter(~alone)
    joined = several.join(_chained(several), [_ID, "block"]).select(*single.columns)
    pieces = written(
        single.union(joined).mapInArrow(_solve, f"{_ID} string, block long, audit string, cost long, illegal long"), "pieces"
    )
    audits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
    costs = pieces.groupBy(_ID).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audits.alias("audit"))
    own_id = F.when(F.col(_ID) != "", F.substring(_ID, 2, 1 << 30)).cast(id_type).alias("conv_id")
    summary = faults.join(costs, _ID).select(own_id, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    # audits meet texts: that of a later block stands before the block's first turn
    none = F.lit(None)
    columns = [_ID, "late", "turn", "role", "digest", "tag", "audit", "text"]
    early = pieces.filter("block = 0").select(
        _ID, F.lit(0).alias("late"), none.cast(turn_field.dataType).alias("turn"), none.cast("string").alias("role"),
        none.cast("binary").alias("digest"), F.lit(0).alias("tag"), "audit", none.cast("string").alias("text"),
    )
    heads = marked.filter((F.col("pos") > 0) & (F.col("pos") % block == 0)).select(_ID, number, "turn", "role", "digest")
    later = pieces.filter("block > 0").join(heads, [_ID, "block"]).select(
        _ID, F.lit(1).alias("late"), "turn", "role", "digest", F.lit(0).alias("tag"), "audit", none.cast("string").alias("text")
    )
    texts = rows.select(_ID, F.lit(1).alias("late"), "turn", "role", "digest", F.lit(1).alias("tag"), none.cast("string").alias("audit"), "text")
    order = [F.col(_ID).asc(), F.col("late").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc(), F.col("tag").asc()]
    together = early.union(later).union(texts).select(*columns).repartition(_ID).sortWithinPartitions(*order)
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"{_ID} string, seq long, edit string, turn {turn_field.dataType.simpleString()}, role string, text string"
    made = together.select(_ID, "audit", "turn", "role", "text").mapInArrow(_edited(to_arrow_type(turn_field.dataType)), schema)
    return summary, made.select(_ID, own_id, "seq", "edit", "turn", "role", "text")


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of ``role:text`` lines, from the turns as :func:`repair` returns them.

    A digest reads its conversation in order, so one task streams it; nothing but the digest's state is held.
    """
    found = repaired.select(_ID, "role", "text").mapInArrow(_hashed, f"{_ID} string, repaired_sha256 string")
    return found.select(F.when(F.col(_ID) != "", F.substring(_ID, 2, 1 << 30)).cast(repaired.schema["conv_id"].dataType).alias("conv_id"), "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with made faults, chosen by ``crc32(conv_id:turn) % 20``; nulls are one space.

    0 drops a turn, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), draw.alias("draw")).filter("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def all_conversations(turns: DataFrame, summary: DataFrame, repaired: DataFrame) -> DataFrame:
    """The summary and digest of every conversation of ``turns``; zeros and an empty audit where no turn was left."""
    ids = turns.select(_key("conv_id").alias(_ID), "conv_id").distinct()
    keyed = lambda frame: frame.withColumn(_ID, _key("conv_id")).drop("conv_id")
    joined = ids.join(keyed(summary), _ID, "left").join(keyed(digests(repaired)), _ID, "left").drop(_ID)
    numbers = [c for c in summary.columns if c not in ("conv_id", "audit")]
    return joined.fillna(0, numbers).fillna({"audit": "", "repaired_sha256": EMPTY_SHA256})
