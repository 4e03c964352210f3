"""Large phrase lists against a plain test of every phrase on every text."""

import random

from pyspark.sql import functions as F

from ragspark.operators import checks as ck
from ragspark.operators import lexicon


def plain(texts, phrases):
    held = {k: set(t.lower().split()) for k, t in texts if t}
    return {(k, p) for k, words in held.items() for p, x in phrases if x and x.split() and set(x.lower().split()) <= words}


def pairs(frame):
    rows = frame.collect()
    got = {(r.doc_id, r.phrase_id) for r in rows}
    assert len(got) == len(rows)
    return got


def test_bags_equal_a_plain_search(spark):
    rng = random.Random(1)
    words = [f"w{int(40 * rng.random() ** 3)}" for _ in range(400)]
    texts = [(i, " ".join(rng.sample(words, rng.randrange(0, 25)))) for i in range(300)] + [(900, None), (901, "")]
    phrases = [(i, " ".join(rng.sample(words, rng.randrange(0, 5)))) for i in range(500)]
    phrases += [(1000, "w1 w1 W1"), (1001, None), (1002, "never said"), (1003, "w1 never"), (1004, phrases[7][1])]
    got = lexicon.phrase_matches(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(phrases, "phrase_id long, phrase string"))
    assert pairs(got) == plain(texts, phrases)


def test_it_finds_what_the_checks_find(spark):
    texts = spark.createDataFrame([(1, "The quick, brown fox!"), (2, "brown quick"), (3, "a fox")], "doc_id long, text string")
    phrases = ["quick brown", "the fox", "fox", "slow fox"]
    listed = spark.createDataFrame(list(enumerate(phrases)), "phrase_id long, phrase string")
    found = pairs(lexicon.phrase_matches(texts, listed))
    viewed, view = ck.prepare(texts, "text", "v")
    for i, phrase in enumerate(phrases):
        hits = {r.doc_id for r in viewed.filter(ck.holds_phrase(view, phrase)).collect()}
        assert hits == {k for k, p in found if p == i}
    assert found == {(1, 0), (2, 0), (1, 1), (1, 2), (3, 2)}


def test_a_hundred_thousand_phrases_and_a_word_in_every_text(spark):
    """The plan does not grow with the list; a word that all texts and most phrases hold is never what a phrase is posted under."""
    texts = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the"), F.concat(F.lit("a"), F.col("id") % 50000), F.concat(F.lit("b"), F.col("id") % 7)).alias("text"))
    phrases = spark.range(100_000).select(F.col("id").alias("phrase_id"), F.concat_ws(" ", F.lit("the"), F.concat(F.lit("a"), F.col("id") % 50000), F.concat(F.lit("b"), F.col("id") % 14)).alias("phrase"))
    found = lexicon.phrase_matches(texts, phrases)
    want = {(i, p) for i in range(3000) for p in (i, i + 50_000) if p % 14 == i % 7}
    assert pairs(found) == want
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_empty_tables(spark):
    texts = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    phrases = spark.createDataFrame([(1, "a")], "phrase_id long, phrase string")
    assert lexicon.phrase_matches(texts.filter("false"), phrases).count() == 0
    assert lexicon.phrase_matches(texts, phrases.filter("false")).count() == 0
    assert pairs(lexicon.phrase_matches(texts, phrases)) == {(1, 1)}


def test_matches_are_not_joined(spark, monkeypatch):
    """Texts meet the list in tasks of a part each, so neither candidates nor matches are shuffled; what is asked of a phrase comes along."""
    monkeypatch.setattr(lexicon, "PART_PHRASES", 20)
    monkeypatch.setattr(lexicon, "_TESTS", 50)
    monkeypatch.setattr(lexicon, "_CELLS", 100)
    monkeypatch.setattr(lexicon, "_ROWS", 7)
    rng = random.Random(2)
    words = [f"w{int(30 * rng.random() ** 2)}" for _ in range(300)]
    said = [(i, " ".join(rng.sample(words, 12))) for i in range(200)]
    # a text whose words lie over many rows of its key, more than a batch
    said += [(300, f"W{i % 31}") for i in range(150)] + [(301, None), (302, "")]
    phrases = [(i, " ".join(rng.sample(words, rng.randrange(1, 5))), i * 10) for i in range(150)]
    whole = {}
    for k, text in said:
        whole[k] = f"{whole.get(k, '')} {text or ''}"
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "16")
    try:
        texts = spark.createDataFrame(said, "doc_id long, text string").repartition(3)
        found = lexicon.phrase_matches(texts, spark.createDataFrame(phrases, "phrase_id long, phrase string, more long"), carry=["more"])
        assert pairs(found) == plain(list(whole.items()), [p[:2] for p in phrases])
        assert found.filter("more <> phrase_id * 10 OR more IS NULL").count() == 0
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(batch, before)
