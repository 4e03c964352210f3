import datetime as dt
import hashlib
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ragspark.operators import admission as ad
from ragspark.operators import ordering, sessions


def limiter(calls, max_calls, window):
    """calls: (id, key, seconds); returns ids of allowed calls."""
    kept, allowed = defaultdict(list), set()
    for cid, key, t in sorted(calls, key=lambda c: (c[2], c[0])):
        kept[key] = [x for x in kept[key] if not t - x > window]
        if len(kept[key]) < max_calls:
            kept[key].append(t)
            allowed.add(cid)
    return allowed


def cache(calls, ttl):
    first, hits = {}, set()
    for cid, key, t in sorted(calls, key=lambda c: (c[2], c[0])):
        if key in first and t - first[key] < ttl:
            hits.add(cid)
        else:
            first[key] = t
    return hits


def random_calls(seed, n, keys, span):
    rng = random.Random(seed)
    return [(i, rng.choice(keys), rng.randrange(span)) for i in range(n)]


CASES = {
    "edges": ([(i, "a", t) for i, t in enumerate([0, 10, 20, 60, 61, 75])], 2, 60),
    "one_window_apart": ([(0, "a", 0), (1, "a", 60), (2, "a", 61), (3, "a", 121)], 1, 60),
    "ties": (random_calls(1, 400, ["a", "b"], 40), 3, 10),
    "hot_key": (random_calls(2, 3000, ["hot"] * 9 + ["x", "y"], 5000), 4, 60),
    "quiet": (random_calls(3, 300, list("abcdef"), 100000), 10, 60),
    "bursts": ([(i, "k", (i // 25) * 100 + i % 7) for i in range(500)], 10, 60),
    "mixed": (random_calls(4, 2000, list("pq"), 20000), 5, 45),
}


def frame(spark, calls):
    return spark.createDataFrame(calls, "id long, key string, s long").withColumn("ts", F.timestamp_seconds("s"))


@pytest.mark.parametrize("cells", [3, 4096])
@pytest.mark.parametrize("name", CASES)
def test_rate_limit(spark, name, cells, monkeypatch):
    monkeypatch.setattr(ad, "_CELLS", cells)
    calls, n, window = CASES[name]
    rows = ad.rate_limit(frame(spark, calls), ["key"], "ts", "id", n, window).collect()
    assert len(rows) == len(calls)
    assert {r.id for r in rows if r.allowed} == limiter(calls, n, window)


@pytest.mark.parametrize("blocks", [(1, 1), (4, 1), (8, 3)])
@pytest.mark.parametrize("name", CASES)
def test_busy_spells_in_blocks(spark, name, blocks, monkeypatch):
    """Spells cut in many blocks, for limits and reuse, equal the fold in sequence."""
    monkeypatch.setattr(ad, "_BLOCK_CELLS", blocks[0])
    monkeypatch.setattr(ad, "_AHEAD_CELLS", blocks[1])
    calls, n, window = CASES[name]
    rows = ad.rate_limit(frame(spark, calls), ["key"], "ts", "id", n, window).collect()
    assert {r.id for r in rows if r.allowed} == limiter(calls, n, window)
    rows = ad.ttl_reuse(frame(spark, calls), ["key"], "ts", "id", window).collect()
    assert {r.id for r in rows if r.is_hit} == cache(calls, window)


def test_one_key_above_its_limit_runs_in_many_tasks(spark, monkeypatch):
    """All rows are one unbroken spell of one key: its blocks are decided apart, and settle."""
    rng = random.Random(9)
    calls, t = [], 0
    for i in range(20_000):
        t += rng.randrange(1, 9)
        calls.append((i, "hot", t))
    seen = {}
    original = ad._piecewise
    monkeypatch.setattr(ad, "_piecewise", lambda rows, *a: seen.setdefault(len(seen), original(rows, *a)))
    rows = ad.rate_limit(frame(spark, calls), ["key"], "ts", "id", 3, 30).collect()
    assert {r.id for r in rows if r.allowed} == limiter(calls, 3, 30)
    spell = seen[len(seen) - 1]
    sizes = [r["count"] for r in spell.groupBy("__piece", "__block").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 0.15 * len(calls)
    seen.clear()
    rows = ad.ttl_reuse(frame(spark, calls), ["key"], "ts", "id", 30).collect()
    assert {r.id for r in rows if r.is_hit} == cache(calls, 30)
    sizes = [r["count"] for r in seen[len(seen) - 1].groupBy("__piece", "__block").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 0.15 * len(calls)


def test_spells_that_never_settle(spark, monkeypatch):
    """Calls of one rhythm keep the phase in which they began, so a wrong start is never forgotten."""
    monkeypatch.setattr(ad, "_BLOCK_CELLS", 2)
    monkeypatch.setattr(ad, "_AHEAD_CELLS", 1)
    calls = [(i, "k", i * 7) for i in range(600)] + [(1000, "k", 3), (1001, "k", 5)]
    rows = ad.rate_limit(frame(spark, calls), ["key"], "ts", "id", 3, 60).collect()
    assert {r.id for r in rows if r.allowed} == limiter(calls, 3, 60)
    rows = ad.ttl_reuse(frame(spark, calls), ["key"], "ts", "id", 60).collect()
    assert {r.id for r in rows if r.is_hit} == cache(calls, 60)


def test_rate_limit_sequence(spark):
    calls, n, window = CASES["edges"]
    rows = ad.rate_limit(frame(spark, calls), ["key"], "s", "id", n, window).orderBy("id").collect()
    assert [r.allowed for r in rows] == [True, True, False, False, True, True]


@pytest.mark.parametrize("name", CASES)
def test_ttl_reuse(spark, name, monkeypatch):
    monkeypatch.setattr(ad, "_CELLS", 3)
    calls, _, ttl = CASES[name]
    rows = ad.ttl_reuse(frame(spark, calls), ["key"], "ts", "id", ttl).collect()
    assert {r.id for r in rows if r.is_hit} == cache(calls, ttl)


@pytest.mark.parametrize("name", ["hot_key", "bursts", "mixed"])
def test_usage(spark, name):
    calls, n, window = CASES[name]
    limited = ad.rate_limit(frame(spark, calls), ["key"], "ts", "id", n, window)
    rows = ad.rate_usage(limited, ["key"], "ts", n, window).collect()
    allowed = [(r.id, r.key, r.s) for r in rows]
    assert {r.id for r in rows} == limiter(calls, n, window)
    for r in rows:
        seen = sum(k == r.key and 0 <= r.s - t <= window for _, k, t in allowed)
        assert r.current_calls == seen <= n and r.remaining_calls == n - seen


def test_times_without_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-03-31 02:30:00.000123' a, timestamp'2024-03-31 02:30:00.000123' b, 1.5D c")
    got = df.select(*[ad.epoch_micros(df, c).alias(c) for c in "abc"]).first()
    micros = int(dt.datetime(2024, 3, 31, 2, 30, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000 + 123
    assert (got.a, got.b, got.c) == (micros, micros, 1_500_000)


def test_fingerprint_is_the_json_hash(spark):
    texts = ["x \"q\"", "สวัสดี", "é\U0001f600\n\x1f\x7f", ""]
    for text in texts:
        row = spark.createDataFrame([(text, 3)], "s string, n long").select(
            ad.call_fingerprint(F.lit("f"), [F.col("s")], kwargs={"b": F.col("n"), "a": F.col("s")}).alias("k")).first()
        key = f"f:{json.dumps([text])}:{json.dumps({'b': 3, 'a': text}, sort_keys=True)}"
        assert row.k == hashlib.sha256(key.encode()).hexdigest()[:16]
    df = spark.createDataFrame([("multiply", 2, "x \"q\"")], "name string, n long, s string")
    got = df.select(
        ad.call_fingerprint(F.col("name"), [F.col("n"), F.col("s")]).alias("a"),
        ad.call_fingerprint(F.col("name"), [F.col("n")], with_name=False).alias("b"),
    ).first()
    key = f"multiply:{json.dumps([2, 'x \"q\"'])}:{json.dumps({})}"
    assert got.a == hashlib.sha256(key.encode()).hexdigest()[:16]
    assert got.b == hashlib.sha256(b"[2]:{}").hexdigest()[:16]


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(6):
        at = 0
        for i in range(200 if conv == 0 else 8):
            at += rng.choice([1, 1, 2, 40])
            rows.append((conv, at, rng.choice(["user", "assistant"]), f"t{conv}-{i}"))
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)


@pytest.mark.parametrize("size", [3, 50, 10_000])
def test_numbering_and_neighbours(spark, turns, size):
    rows, df = turns
    groups = defaultdict(list)
    for conv, at, role, text in sorted(rows):
        groups[conv].append((at, text))
    numbered = {(r.conv_id, r.turn): r.n for r in ordering.number_rows(df, ["conv_id"], "turn", rows=size).collect()}
    near = {(r.conv_id, r.turn): r for r in ordering.with_neighbours(df, ["conv_id"], "turn", ["text"], rows=size).collect()}
    assert len(numbered) == len(near) == len(rows)
    for conv, items in groups.items():
        for i, (at, _) in enumerate(items):
            assert numbered[conv, at] == i + 1
            before, after = near[conv, at].previous, near[conv, at].following
            assert (before.text if before else None) == (items[i - 1][1] if i else None)
            assert (after.text if after else None) == (items[i + 1][1] if i + 1 < len(items) else None)


def test_ranges_hold_few_rows_whatever_the_order_values(spark):
    """Milliseconds since 1970, and one outlier far from all others."""
    times = [1_700_000_000_000 + 977 * i for i in range(4000)] + [10**18]
    df = spark.createDataFrame([(1, t) for t in times], "k int, t long").repartition(5)
    sizes = [r["count"] for r in ordering._ranged(df, ["k"], "t", 1000).groupBy("__range").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 100
    got = {r.t: r.n for r in ordering.number_rows(df, ["k"], "t", rows=1000).collect()}
    assert got == {t: i + 1 for i, t in enumerate(times)}


def test_session_questions(spark):
    rows = [(1, 0, " hi "), (1, 1, "  "), (1, 2, "more"), (1, 3, "EXIT "), (1, 4, "late"), (2, 0, "จบ"), (3, 0, "exit now")]
    df = spark.createDataFrame(rows, "s long, o long, t string")
    got = sessions.session_questions(df, "s", "o", "t").orderBy("s", "o").collect()
    assert [(r.s, r.question, r.question_no, r.total_questions) for r in got] == [
        (1, "hi", 1, 2), (1, "more", 2, 2), (3, "exit now", 1, 1),
    ]


def test_query_log(spark):
    df = spark.createDataFrame([("q" * 600, "answer", None), ("why", "ü", "u1")], "question string, answer string, uid string")
    summary = sessions.document_summary(F.lit("d" * 250), F.create_map(F.lit("source"), F.lit("f")))
    log = sessions.query_log(df, {"llm_model": "m", "tools_enabled": "true"}, user_id=F.col("uid"), docs=F.array(summary))
    rows = log.orderBy("question_length").collect()
    assert (rows[0].user, rows[1].user, rows[1].session) == ("u1", "anonymous", "default")
    assert len(rows[1].logged_question) == 500 and rows[1].question_length == 600
    assert rows[0].execution_mode == "agent" and rows[0].prompt_template_version == "latest"
    docs = json.loads(rows[0].retrieved_docs)
    assert docs[0]["content"] == "d" * 200 + "..." and docs[0]["length"] == 250 and docs[0]["score"] is None
    assert json.loads(rows[1].qa_pair)["user_id"] is None and json.loads(rows[0].qa_pair)["answer"] == "ü"
    assert rows[0].avg_doc_length == 250.0 and rows[0].answer_length == 1
    bare = sessions.query_log(df, {}).first()
    assert (bare.num_retrieved_docs, bare.avg_doc_length, bare.retrieved_docs) == (0, 0.0, None)
