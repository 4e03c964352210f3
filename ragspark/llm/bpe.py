"""Byte-level BPE by monoid tree reduction.

A match of the pre-tokenizer is encoded as a tree: the encodings of its halves are joined by re-encoding a
window of tokens around the boundary. The window grows on each side until the token outside and the
window's edge token form a stable pair, one that encodes to itself. A sequence in which each pair of
neighbours is stable is the encoding of its bytes, so what lies outside is proved right. Decoding
concatenates halves up the tree.

Matches are found for a whole text at once from the classes of its characters: a boundary depends on at
most the four characters around it. Ranks and pattern are those of the public tokenizer files; the path of
the rank file is a parameter.

Null texts encode like empty ones, to no tokens. Equal texts give equal results; texts of any length are
encoded whole. Memory is bounded by the longest text and by caches of bounded size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable
from hashlib import sha256
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ragspark.llm.common import kept_in_worker, map_texts

#: Matches of which a worker keeps the encodings, in two generations; entries of the smaller tables.
KNOWN = 700_000
CACHE = 200_000
_NONE = 1 << 40
_SHORT = 48  # bytes up to which a plain search for the next merge is quickest

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class MergeTree:
    """Encodes byte strings with a rank table."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._trees: dict[bytes, tuple[int, ...]] = {}
        self._pairs: dict[int, tuple[int, ...]] = {}

    def encode(self, match: bytes) -> tuple[int, ...]:
        """Tokens of one match of the pre-tokenizer; a match that is a token is that token."""
        rank = self.ranks.get(match)
        if rank is not None:
            return (rank,)
        middle = len(match) // 2
        return self.join(self.tree(match[:middle]), self.tree(match[middle:]))

    def tree(self, raw: bytes) -> tuple[int, ...]:
        if len(raw) < 2:
            return (self.ranks[raw],) if raw else ()
        found = self._trees.get(raw)
        if found is None:
            middle = len(raw) // 2
            found = self.join(self.tree(raw[:middle]), self.tree(raw[middle:]))
            if len(self._trees) >= CACHE:
                self._trees.clear()
            self._trees[raw] = found
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the bytes of two encodings, from theirs."""
        if not left or not right:
            return left + right
        a, b = left[-1], right[0]
        window = self.pair(a, b)
        if window == (a, b):
            return left + right
        i = j = 1
        while True:
            left_ok = i == len(left) or self.stable(left[-i - 1], window[0])
            right_ok = j == len(right) or self.stable(window[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + window + right[j:]
            if not left_ok:
                i = min(2 * i, len(left))
            if not right_ok:
                j = min(2 * j, len(right))
            window = self.merge(b"".join([self.tokens[t] for t in left[len(left) - i :] + right[:j]]))

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """Encoding of the bytes of two tokens."""
        key = a << 32 | b
        found = self._pairs.get(key)
        if found is None:
            found = self.merge(self.tokens[a] + self.tokens[b])
            if len(self._pairs) >= CACHE:
                self._pairs.clear()
            self._pairs[key] = found
        return found

    def stable(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens stay as they are."""
        return self.pair(a, b) == (a, b)

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Lowest-rank merges first, the leftmost of equal ones; applied to windows only."""
        if len(raw) > _SHORT:
            return self._merge_long(raw)
        rank_of, none = self.ranks.get, _NONE
        cuts = list(range(len(raw) + 1))
        pairs = [rank_of(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pairs and (best := min(pairs)) != none:
            at = pairs.index(best)
            del cuts[at + 1], pairs[at]
            if at:
                pairs[at - 1] = rank_of(raw[cuts[at - 1] : cuts[at + 1]], none)
            if at < len(pairs):
                pairs[at] = rank_of(raw[cuts[at] : cuts[at + 2]], none)
        return tuple([self.ranks[raw[i:j]] for i, j in zip(cuts, cuts[1:])])

    def _merge_long(self, raw: bytes) -> tuple[int, ...]:
        n = len(raw)
        rank_of = self.ranks.get
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is part of another
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, start, stop = heapq.heappop(heap)
            middle = end[start]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[start], end[middle] = stop, 0
            if stop < n:
                before[stop] = start
                if (r := rank_of(raw[start : end[stop]])) is not None:
                    heapq.heappush(heap, (r, start, end[stop]))
            left = before[start]
            if left >= 0 and (r := rank_of(raw[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        return tuple([self.ranks[raw[i : end[i]]] for i in range(n) if end[i]])

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) > 4096:
            middle = len(ids) // 2
            return self.decode(ids[:middle]) + self.decode(ids[middle:])
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def character_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other.

    White space is Unicode's property, as the pattern reads it; Python's ``isspace`` also holds four
    control characters, which are other here.
    """
    import unicodedata

    out = np.full(0x110000, _OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))
        if kind[0] == "L":
            out[point] = _LETTER
        elif kind[0] == "N":
            out[point] = _NUMBER
        elif kind[0] == "Z" or point in (9, 10, 11, 12, 13, 0x85):
            out[point] = _SPACE
    return out


def boundaries(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Start of each match of the pre-tokenizer pattern in an array of code points."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[points]
    starts = np.empty(n, bool)
    starts[0] = True
    starts[1:] = kind[1:] != kind[:-1]
    space = kind == _SPACE
    # the last white space before something else is on its own, or leads it if it is a blank
    last = np.flatnonzero(space[:-1] & ~space[1:])
    starts[last] = True
    starts[last[points[last] == 0x20] + 1] = False
    # 's 't 'm 'd 're 've 'll where a match starts at the apostrophe
    mark = np.flatnonzero(points[:-1] == 0x27)
    mark = mark[starts[mark]]
    if len(mark):
        ahead = points[mark + 1]
        ahead2 = points[np.minimum(mark + 2, n - 1)]
        whole = mark + 2 < n
        two = whole & (((ahead2 == ord("e")) & ((ahead == ord("r")) | (ahead == ord("v")))) | ((ahead == ord("l")) & (ahead2 == ord("l"))))
        one = np.isin(ahead, np.array([ord(c) for c in "stmd"], points.dtype))
        for at, size in ((mark[one], 1), (mark[two & ~one], 2)):
            starts[at + 1] = False
            after = at + 1 + size
            starts[after[after < n]] |= kind[after[after < n]] == _LETTER
    return np.flatnonzero(starts)


class TextCodec:
    """Splits and encodes whole texts; keeps the encodings of matches seen lately."""

    def __init__(self, tree: MergeTree, classes: np.ndarray) -> None:
        self.tree, self.classes = tree, classes
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        cuts = boundaries(points, self.classes).tolist()
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(points)])]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        known = self._known
        out = []
        for match in self.split(text):
            ids = known.get(match)
            if ids is None:
                ids = self._older.get(match)
                if ids is None:
                    tokens = self.tree.encode(match.encode())
                    ids = pack(f"<{len(tokens)}I", *tokens)
                if len(known) >= KNOWN // 2:
                    self._older, self._known = known, {}
                    known = self._known
                known[match] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return self.tree.decode(np.frombuffer(ids, "<u4").tolist())


def codec(ranks: dict[bytes, int] | str) -> TextCodec:
    """A codec for a rank table or its file; that of a file is kept for the tasks that a worker runs later."""
    if isinstance(ranks, str):
        return kept_in_worker(f"codec {ranks}", lambda: TextCodec(MergeTree(read_ranks(ranks)), character_classes()))
    return TextCodec(MergeTree(ranks), character_classes())


def public_path(name: str) -> str:
    """Where a file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _over(docs: DataFrame, text: str, ranks: dict[bytes, int] | str, work: Callable, fields: str) -> DataFrame:
    def fresh():
        own = codec(ranks)
        return lambda texts: work(own, texts)

    return map_texts(docs, text, fresh, fields)


def encoded(docs: DataFrame, ranks: dict[bytes, int] | str, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ``n_tokens`` and ``ids``, an array of token ids."""

    def work(own: TextCodec, texts: list) -> dict[str, pa.Array]:
        rows = [np.frombuffer(own.encode(t or ""), "<u4") for t in texts]
        flat = pa.array(np.concatenate([*rows, np.zeros(0, np.uint32)]).astype(np.int32))
        ends = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
        return {"n_tokens": pa.array([len(r) for r in rows], pa.int64()), "ids": pa.ListArray.from_arrays(ends, flat)}

    return _over(docs, text, ranks, work, "n_tokens long, ids array<int>")


def decoded(rows: DataFrame, ranks: dict[bytes, int] | str, ids: str = "ids") -> DataFrame:
    """``rows`` with the ids replaced by ``body``, the bytes they stand for; null ids give no bytes."""
    from pyspark.sql import types as T

    kept = [f for f in rows.schema.fields if f.name not in (ids, "body")]
    names = [f.name for f in kept]

    def run(batches):
        tree = codec(ranks).tree
        for batch in batches:
            body = pa.array([tree.decode(r or []) for r in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), body], [*names, "body"])

    return rows.select(*names, ids).mapInArrow(run, T.StructType([*kept, T.StructField("body", T.BinaryType())]))


def digests(docs: DataFrame, ranks: dict[bytes, int] | str, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ``n_tokens`` and the SHA-256 of its ids and of the bytes they decode to."""

    def work(own: TextCodec, texts: list) -> dict[str, pa.Array]:
        counts, of_ids, of_bytes = [], [], []
        for text in texts:
            ids = own.encode(text or "")
            counts.append(len(ids) // 4)
            of_ids.append(sha256(ids).hexdigest())
            of_bytes.append(sha256(own.decode(ids)).hexdigest())
        return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string())}

    return _over(docs, text, ranks, work, "n_tokens long, ids_sha256 string, decoded_sha256 string")
