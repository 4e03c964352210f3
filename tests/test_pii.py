import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ragspark.operators import checks as ck
from ragspark.operators import pii, rules


def spans(text, patterns):
    out = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text, re.I):
            out.append((m.start(), rank, m.end(), kind, m.group()))
    return sorted(out)


def keep_format(value, masked):
    digits = iter(masked)
    return "".join(next(digits) if c.isdigit() else c for c in value)


def mask(kind, value):
    digits = "".join(c for c in value if c.isdigit())
    if kind == "email" and value.count("@") == 1:
        user, domain = value.split("@")
        hidden = user[0] + "*" * (len(user) - 2) + user[-1] if len(user) > 2 else "*" * len(user)
        return f"{hidden}@{domain}"
    if kind.startswith("phone") and len(value) > 4:
        return value[:2] + "*" * (len(value) - 4) + value[-2:]
    if kind == "credit_card" and len(digits) > 4:
        return keep_format(value, "*" * (len(digits) - 4) + digits[-4:])
    if kind == "thai_id" and len(digits) >= 13:
        return keep_format(value, digits[0] + "*" * 8 + digits[-4:])
    return "".join(c if c == " " else "*" for c in value)


def masked(text, found):
    for start, _, end, kind, value in sorted(found, key=lambda s: s[0], reverse=True):
        text = text[:start] + mask(kind, value) + text[end:]
    return text


def hard_texts():
    rng = random.Random(7)
    parts = ["john.doe@example.com", "+66 81 234 5678", "0812345678", "1 1234 12345 12 3", "4111 1111 1111 1234",
             "4111-1111-1111-1234", "123-45-6789", "John Smith", "สมชาย ใจดี", "é", "a@b.co", "x_y@z.org", "..", "\n",
             "ſmith Kelvin", "1234567890123456", "ü", "hello", "๑๒๓๔ ๕๖๗๘"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", ",", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]


def test_spans_and_masks_against_python(spark, documents):
    texts = hard_texts() + [r.text for r in documents.select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(8)
    rows = df.select("id", pii.mask_pii(F.col("text")).alias("m")).orderBy("id").collect()
    for text, row in zip(texts, rows):
        expected = spans(text, rules.PII)
        got = [(s.start, s.end, s.type, s.value) for s in row.m.spans]
        assert got == [(a, c, k, v) for a, _, c, k, v in expected], text[:200]
        # equal starts: the reference order keeps the later pattern on top
        assert row.m.masked_text == masked(text, expected), text[:200]
        assert len(row.m.masked_text) == len(text)


def test_texts_that_hold_the_mark(spark):
    text = "\uffff a@b.co\uffffc@d.org \uffff0812345678"
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(pii.mask_pii(F.col("text"), {"mark": "\uffff."}).alias("m")).first().m
    want = spans(text, {**rules.PII, "mark": "\uffff."})
    assert [(s.start, s.end, s.type, s.value) for s in got.spans] == [(a, c, k, v) for a, _, c, k, v in want]
    assert got.masked_text == masked(text, want)


def test_confidence(spark):
    df = spark.createDataFrame([("Al Bo meets Alexander Hamilton",)], "text string")
    got = df.select(pii.detect_pii(F.col("text"), enabled_types=["potential_name"]).alias("s")).first().s
    assert [(s.value, s.confidence) for s in got] == [("Al Bo", 0.6), ("meets Alexander", 0.6)]
    df = spark.createDataFrame([("A Bo no", )], "text string")
    assert df.select(pii.detect_pii(F.col("text"), {"zip": "no"}, ["zip"]).alias("s")).first().s[0].confidence == 0.8


def test_options(spark):
    df = spark.createDataFrame([("Ann Lee wrote to ann@example.com today again",)], "text string")
    t = F.col("text")
    sensitive = df.select(pii.detect_pii(t, case_sensitive_names=True).alias("s")).first().s
    assert [s.value for s in sensitive] == ["Ann Lee", "ann@example.com"]
    kept = df.select(pii.mask_pii(t, enabled_types=["email"], allowed_types=["email"])["masked_text"]).first()[0]
    assert kept == "Ann Lee wrote to ann@example.com today again"
    merged = df.select(pii.mask_pii(t, merge_overlaps=True)["masked_text"]).first()[0]
    assert merged == "*** *** ***** ** *************** ***** again"
    with pytest.raises(ValueError):
        pii.mask_pii(t, mask_char="##")
    with pytest.raises(ValueError):
        pii.pii_patterns({"bad": "("})
    with pytest.raises(ValueError):
        pii.pii_patterns(enabled_types=["nothing"])


def test_verdict(spark):
    texts = ["nothing here", "call 0812345678", "123-45-6789 then a.b@example.com", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    view = ck.TextView.of(F.col("text"))
    kinds = ["email", "phone_thai", "ssn"]
    strict = pii.pii_check(view, enabled_types=kinds).column
    lenient = pii.pii_check(view, enabled_types=kinds, fail_on_pii=False, allowed_types=["phone_thai"]).column
    rows = df.select("id", strict.alias("s"), lenient.alias("l")).orderBy("id").collect()
    assert [r.s.result for r in rows] == ["pass", "fail", "fail", "pass"]
    assert [r.l.result for r in rows] == ["pass", "pass", "warning", "pass"]
    assert [r.l.confidence for r in rows] == [0.9, 0.8, 0.9, 1.0]
    assert rows[2].s.message == "PII detected: ['ssn', 'email']"
    assert rows[1].l.message == "Only allowed PII types detected"
    assert json.loads(rows[2].s.metadata)["masked_text"] == "*********** then a*b@example.com"


def test_counts_equal_spans(spark, documents):
    t = F.col("text")
    for kind in rules.PII:
        both = documents.select(
            F.sum(pii.count_pii(t, kind)).alias("n"),
            F.sum(F.size(pii.detect_pii(t, enabled_types=[kind]))).alias("m"),
        ).first()
        assert both.n == both.m


def test_addresses_equal_the_plain_search(spark):
    """Runs of every kind before, between and after addresses, against the pattern itself."""
    rng = random.Random(11)
    pieces = ["a", "b1", ".", "-", "%", "@", "@x.co", "@y.c", "@z.org.x", "é", " ", "_", "..", "@-.", "\u0e01", "K", "@m.COM|", "\uffff", "\ufdd0"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    pattern = re.compile(rules.PII["email"], re.IGNORECASE)
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = frame.select("n", pii.detect_pii(F.col("t"), enabled_types=["email"]).alias("s"), pii.count_pii(F.col("t"), "email").alias("c")).collect()
    found = 0
    for r in got:
        want = [(m.start(), m.end(), m.group()) for m in pattern.finditer(texts[r.n])]
        assert [(x.start, x.end, x.value) for x in r.s] == want and r.c == len(want), texts[r.n]
        found += len(want)
    assert found > 300


@pytest.mark.parametrize("run", ["a.", "-", "a@", "a@b.", ".a1-", "@b.c"])
def test_long_runs_take_linear_time(spark, run):
    """50,000 characters beside a real address, before and after it, in under a second each."""
    text = run * (50_000 // len(run))
    frame = spark.createDataFrame([(f"{text} me@mail.org {text}",), (f"{text}me@mail.org{text}",)], "t string").coalesce(1)
    query = frame.select(F.size(pii.detect_pii(F.col("t"), enabled_types=["email"])).alias("n"))
    query.collect()
    start = time.time()
    assert all(r.n >= 1 for r in query.collect())
    assert time.time() - start < 2


def test_masks_of_spans_apart_touching_and_over_each_other(spark):
    """Spans that lie apart are written as they stand; a star stands for each character but spaces, however many there are."""
    custom = {"a": "a+", "ab": "ab c  d", "e": "e|", "f": "f f"}
    texts = ["aab c  d x", "xxf fe", "aaf fxe", "f f", "é𝄞a", "ab c  d", ""]
    stars = lambda t: re.sub("[^ ]", "*", t)
    want = [stars("aab c  d") + " x", "xx* **", "*** *x*", "* *", "é𝄞*", stars("ab c  d"), ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    masked = pii.mask_pii(F.col("t"), custom, ["a", "ab", "e", "f"])["masked_text"]
    assert [r.m for r in df.select("i", masked.alias("m")).orderBy("i").collect()] == want
