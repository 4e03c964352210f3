"""The prefix trie against a plain walk over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ragspark.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_sequences(rows):
    own = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, (role or "").encode(), hashlib.sha256((text or "").encode()).hexdigest(), (role or "", text or "")))
    turns = {c: [r[-1] for r in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = abs(c) // 5 * 5 * (1 if c >= 0 else -1)
        out[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    return out


def plain_trie(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sequences.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = defaultdict(int), defaultdict(int)
    for s in sorted(members, key=len, reverse=True):
        leaves[s] += not children[s]
        saved[s] += (len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0
        if s:
            leaves[s[:-1]] += leaves[s]
            saved[s[:-1]] += saved[s]
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
    return sorted(
        (min(m), len(s), min(members[s[:-1]]) if s else -1, len(m), len(children[s]), leaves[s], saved[s], digest(s)) for s, m in members.items()
    )


def result(frame):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[c] is None else r[c] for c in columns) for r in frame.collect())


def made(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, conversations * 2), conversations):
        for n in range(rng.randrange(1, longest)):
            rows.append((c, rng.choice([n, n, n, n // 2, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "ccc", "a"])))
    return rows


@pytest.mark.parametrize("seed, conversations, longest, block", [(1, 150, 6, trie.BLOCK), (2, 60, 30, 4), (3, 80, 12, 1)])
def test_nodes_equal_a_plain_walk(spark, seed, conversations, longest, block):
    rows = made(seed, conversations, longest)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(trie.trie(*trie.rebuilt(frame), block=block)) == plain_trie(plain_sequences(rows))


def test_many_copies_and_one_long_conversation(spark):
    """A third of all conversations are one sequence, and one conversation has a third of all rows."""
    rows = [(5 * c + 1, n, "user", f"same {n}") for c in range(400) for n in range(12)]
    rows += [(5 * c + 2, n, "user", f"{n} of {c}") for c in range(300) for n in range(9)]
    rows += [(10_000_002, n, "user", f"long {n}") for n in range(4000)] + [(10_000_007, n, "user", f"long {n}") for n in range(2000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(trie.trie(*trie.rebuilt(frame), block=100)) == plain_trie(plain_sequences(rows))


def test_lists_of_ends_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = [("k", c) for c in (7, 100, 9, -5, 12, 3, 44, 8)] + [("x", 1)]
    got = {r.key: r.ends_sha256 for r in trie.end_digests(spark.createDataFrame(rows, "key string, conv_id long").repartition(3)).collect()}
    assert got == {k: hashlib.sha256(",".join(str(c) for c in sorted(i for x, i in rows if x == k)).encode()).hexdigest() for k in "kx"}


def test_odd_tables(spark):
    rows = [(None, 1, "user", "x"), (0, None, None, None), (1, 5, "user", "long " * 100_000), (1, 5, "user", "long " * 100_000), (6, 1, "", "")]
    frame = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA + ", depth int, key string, rep int")
    assert result(trie.trie(*trie.rebuilt(frame))) == plain_trie(plain_sequences(rows))
    assert result(trie.trie(*trie.rebuilt(frame.filter("false")))) == []
    assert result(trie.trie(*trie.rebuilt(frame.filter("conv_id IS NULL")))) == []


def test_the_given_conversations(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op13_prefix_trie(spark, data)) == plain_trie(plain_sequences(rows))
