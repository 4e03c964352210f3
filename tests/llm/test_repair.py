"""Structure repair against a plain search over all edits, and the made faults."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ragspark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\f\r"


def plain_damage(rows):
    out = []
    for c, n, role, text in rows:
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 0:
            continue
        if draw == 1:
            text = ""
        if draw == 2:
            text = "".join(x for x in text if x not in ".!?")
        if draw == 4:
            role = "user"
        out += [(c, n, role, text)] * (2 if draw == 3 else 1)
    return out


def plain_repair(rows):
    """One conversation: gaps, faults, misplaced turns, cost, audit and repaired lines, by least (cost, audit) of each prefix and state."""
    rows = [(n, " " if r is None else r, " " if t is None else t) for n, r, t in rows]
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    turns = [n for n, _, _ in rows if n is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts, seen, faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def better(table, state, cost, audit, lines):
        if state not in table or (cost, audit) < table[state][:2]:
            table[state] = (cost, audit, lines)

    def insert(table):
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in step:
                        better(table, step[state, role[0]], cost + 5, audit + "I", (*lines, role + ":"))

    for (_, role, text), fault in zip(rows, faults):
        insert(best)
        after = {}
        for state, (cost, audit, lines) in best.items():
            better(after, state, cost + 2, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault else 0
            if (state, role[:1]) in step:
                better(after, step[state, role[:1]], cost + more, audit + "K", (*lines, f"{role}:{text}"))
            for new in ("user", "assistant"):
                if (state, new[0]) in step:
                    better(after, step[state, new[0]], cost + more + 1, audit + "R", (*lines, f"{new}:{text}"))
        best = after
    insert(best)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows, damage=True):
    out = {c: (0, 0, 0, 0, 0, 0, "", repair.EMPTY_SHA256) for c, *_ in rows}
    groups = defaultdict(list)
    for c, *row in plain_damage(rows) if damage else rows:
        groups[c].append(row)
    return out | {c: plain_repair(g) for c, g in groups.items()}


def result(frame):
    rows = frame.collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def run(spark, rows, damage=True, **how):
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return result(repair.all_conversations(turns, *repair.repair(repair.damaged(turns) if damage else turns, **how)))


def made(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut", "cut off ", "", " \n", None, "Well. ", "x.y"]
    rows = []
    for c in range(conversations):
        for n in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(texts) if rng.random() < 0.5 else f"text {n} {rng.randrange(9)}{rng.choice('.!?x')}"
            rows.append((c, rng.choice([n, n, n, n // 2, n + 3, None]), role, text))
    return rows


def test_least_audits_of_all_short_sequences():
    """All codes of up to three turns at once, against the plain search."""
    kinds = [(c, f) for c in "suax" for f in (None, "truncated", "blank")]
    sequences = [[k] for k in kinds] + [[a, b] for a in kinds for b in kinds] + [[a, b, c] for a in kinds for b in kinds for c in kinds]
    sequences = [[]] + sequences
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    codes = ["".join(repair._CODES["suax".index(c) + (0 if f is None else 4 if f == "truncated" else 8)] for c, f in q) for q in sequences]
    ends = np_ends(len(codes))
    layers = repair.Layers(codes, *ends)
    audits, _ = repair.least_audits(layers, [0] * len(codes))
    texts = {None: "t{}.", "truncated": "t{}", "blank": " "}
    for q, audit, first in zip(sequences, audits, layers.first):
        expected = plain_repair([(i, roles[c], texts[f].format(i)) for i, (c, f) in enumerate(q)])
        assert (layers.togo[first, 0], audit) == expected[5:7], q


def np_ends(n):
    import numpy as np

    return np.array([repair.END] * n), np.ones(n, dtype=bool)


@pytest.mark.parametrize("block", [repair.BLOCK, 1, 3])
def test_conversations_equal_the_plain_search(spark, block):
    rows = made(1, 120, 14) + [(None, 1, "user", "Hm."), (None, 2, "assistant", "Yes."), (None, None, "system", "So.")]
    assert run(spark, rows, block=block) == plain(rows)


def test_blocks_of_a_long_conversation(spark):
    """A conversation with most of all rows, cut in many blocks; runs that only insertions or deletions can mend."""
    rng = random.Random(5)
    rows = [(1, n, rng.choice(["user", "assistant"]), f"line {n}{rng.choice('.....x')}") for n in range(3000)]
    rows += [(2, n, "user", f"only {n}.") for n in range(200)] + [(3, 7, "user", "same.")] * 300 + [(4, n, "user", "again.") for n in range(300)]
    got = run(spark, rows, damage=False, block=64)
    assert got == plain(rows, damage=False)
    assert got[3][2] == 299 and got[4][2] == 299


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Hello."), (3, 1, "system", "Be kind.")]
    summary, turns = repair.repair(spark.createDataFrame(rows, SCHEMA))
    got = sorted(tuple(r)[1:] for r in turns.collect())
    assert got == [
        (1, 0, "K", 1, "user", "There?"),
        (1, 1, "K", 2, "assistant", "Yes."),
    ]
    assert {r.conv_id: (r.cost, r.audit) for r in summary.collect()} == {1: (2, "DKK"), 2: (2, "D"), 3: (2, "D")}


def test_odd_tables(spark):
    assert run(spark, []) == {}
    rows = [(1, None, None, None), (2, 1, "", ""), (3, 1, "assistant", "word " * 50_000 + "."), (3, 2, "user", "é" * 100_000), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, 1, "a", 0) for r in rows], SCHEMA + ", pos int, codes string, block int")
    assert result(repair.all_conversations(frame, *repair.repair(repair.damaged(frame)))) == plain(rows)


def test_the_given_conversations(spark, data):
    from ragspark.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op12_structure_repair(spark, data)) == plain(rows)
