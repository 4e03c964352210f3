import re
import string

import pytest
from pyspark.sql import functions as F

from ragspark.functions import text as tx

LANGUAGES = [
    ("สวัสดีครับ", "th"),
    ("ผมชื่อสมชาย", "th"),
    ("Python คือภาษาโปรแกรมมิ่ง", "th"),
    ("Hello world", "en"),
    ("Python is a programming language", "en"),
    ("How are you?", "en"),
    ("Hello สวัสดีครับ", "th"),
    ("Python คือ programming language", "en"),
    ("", "en"),
    (None, "en"),
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def values(spark, texts, *columns):
    return frame(spark, texts).select("id", *columns).orderBy("id").collect()


def test_language(spark):
    rows = values(spark, [t for t, _ in LANGUAGES], tx.detect_language(F.col("text")).alias("l"))
    assert [r.l for r in rows] == [e for _, e in LANGUAGES]


def test_empty_inputs(spark):
    t = F.col("text")
    for row in values(
        spark,
        ["", None],
        tx.tokens(t).alias("t"),
        tx.keywords(t).alias("k"),
        tx.sentences(t).alias("s"),
        tx.text_similarity(t, F.lit("x y z")).alias("sim"),
        tx.top_words(t).alias("top"),
    ):
        assert (row.t, row.k, row.s, row.sim, row.top) == ([], [], [], 0.0, [])


def test_tokens_against_python(spark, documents):
    for row in documents.select("text", tx.tokens(F.col("text")).alias("t")).collect():
        assert row.t == re.findall(r"\b\w+\b", row.text.lower())


def jaccard(a, b):
    if not a or not b:
        return 0.0
    x, y = ({w for w in re.findall(r"\w+", t.lower()) if len(w) >= 2} for t in (a, b))
    if not x and not y:
        return 1.0
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.mark.parametrize(
    "pair", [("machine learning is fun", "learning machine"), ("a b", "c d"), ("a", "long word"), ("same", "same"), ("", "x")]
)
def test_similarity(spark, pair):
    df = spark.createDataFrame([pair], "a string, b string")
    got = df.select(
        tx.text_similarity(F.col("a"), F.col("b")).alias("x"),
        tx.text_similarity(F.col("b"), F.col("a")).alias("y"),
    ).first()
    assert got.x == pytest.approx(jaccard(*pair)) and got.x == got.y


def test_sentences(spark):
    rows = values(
        spark,
        ["One. Two!  Three?? ...", "no mark", "สวัสดีครับ ผมชื่อ\nสมชาย"],
        tx.sentences(F.col("text")).alias("s"),
    )
    assert [r.s for r in rows] == [
        ["One", "Two", "Three"], ["no mark"], ["สวัสดีครับ", "ผมชื่อ", "สมชาย"],
    ]


def words_record(text):
    words = text.split()
    mean = sum(len(w.strip(".,!?;:")) for w in words) / len(words) if words else 0.0
    return len(words), len(text), len(text.replace(" ", "")), len(re.findall(r"[.!?]+", text)), mean


def test_count_words_against_python(spark, documents):
    odd = ["", "a", "...a... b!!", "!!! ...", "x y z", "  lead. trail;  ", "a.b,c"]
    texts = odd + [r.text for r in documents.select("text").collect()]
    for text, row in zip(texts, values(spark, texts, tx.count_words(F.col("text")).alias("s"))):
        s = row.s
        got = s.word_count, s.character_count, s.character_count_no_spaces, s.sentence_count
        assert got == words_record(text)[:4], text
        assert s.word_length == pytest.approx(words_record(text)[4])


def test_mean_word_length_ties_round_to_even(spark):
    row = values(spark, ["aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaaa"], tx.count_words(F.col("text")).alias("s"))[0]
    assert row.s.average_word_length == 4.12


def top_five(text):
    seen = {}
    for word in text.lower().split():
        word = re.sub(r"[^\w]", "", word)
        if len(word) > 2:
            seen[word] = seen.get(word, 0) + 1
    return sorted(seen.items(), key=lambda x: -x[1])[:5]


def test_top_words_against_python(spark, documents):
    for row in documents.select("text", tx.top_words(F.col("text")).alias("w")).collect():
        assert [(w["word"], w["count"]) for w in row.w] == top_five(row.text)


def test_analyze_text(spark):
    rows = tx.analyze_text(frame(spark, ["Hi there. I am ok.", "สวัสดี hello", "12 34", ""])).orderBy("id").collect()
    assert [r.language_detected for r in rows] == ["english", "mixed", "unknown", "unknown"]
    assert [r.readability_score for r in rows] == ["easy", "medium", "easy", "unknown"]
    assert [r.average_sentence_length for r in rows] == [2.5, 0.0, 0.0, 0.0]


def test_word_frequency(spark):
    rows = tx.word_frequency(frame(spark, ["one two two", "Two, three"])).collect()
    assert {r["word"]: r["count"] for r in rows} == {"one": 1, "two": 3, "three": 1}
    assert not any(c in string.punctuation for r in rows for c in r["word"])


def test_segmenter_and_stop_words(spark):
    cut = lambda t: F.split(F.regexp_replace(t, "ครับ", "|ครับ"), "[|]")
    row = values(
        spark,
        ["สวัสดีครับ"],
        tx.tokens(F.col("text"), cut).alias("s"),
        tx.tokens(F.lit("the cat and the dog"), stop_words=["the", "and"]).alias("t"),
    )[0]
    assert row.s == ["สวัสดี", "ครับ"] and row.t == ["cat", "dog"]
