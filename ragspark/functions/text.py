"""Text columns: language, tokens, similarity, sentences, counts and readability."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.arrays import bind, empty_array, explode_rows
from ragspark.functions.patterns import NOT_SPACE, SPACE, WORD

_THAI = r"\x{0E00}-\x{0E7F}"
_THAI_SHARE = 0.3
_EDGE_MARKS = r"[.,!?;:]"


def no_words() -> Column:
    return empty_array("string")


def is_blank(text: Column) -> Column:
    """Null or of length zero."""
    return text.isNull() | (text == "")


def detect_language(text: Column) -> Column:
    """``th`` if Thai characters exceed 0.3 of the letters, else ``en``.

    The letters counted below the line leave out combining marks, so the share
    of a Thai text may exceed one.
    """
    thai = F.regexp_count(text, F.lit(f"[{_THAI}]"))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    share = F.when(text.rlike(f"[{_THAI}]") & (letters > 0), thai / letters)
    return F.when(share > _THAI_SHARE, "th").otherwise("en")


def fold_case(lower: Column) -> Column:
    """Lower-cased text with the two letters that only case-insensitive matching equates."""
    odd = F.contains(lower, F.lit("\u017f")) | F.contains(lower, F.lit("\u0131"))
    return F.when(odd, F.translate(lower, "\u017f\u0131", "si")).otherwise(lower)


def tokens(
    text: Column,
    segment: Callable[[Column], Column] | None = None,
    stop_words: list[str] | None = None,
) -> Column:
    """Words of a text; lower-cased unless Thai. Null gives an empty array.

    ``segment`` may cut Thai text into words, for instance a pandas UDF over a
    dictionary segmenter. Stop words are removed only if given.
    """
    latin = F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+"), F.lit(0))
    if segment is None:
        thai = F.regexp_extract_all(text, F.lit(rf"[{WORD}\p{{M}}]+"), F.lit(0))
    else:
        thai = segment(text)
    words = F.when(detect_language(text) == "th", thai).otherwise(latin)
    return drop_words(F.coalesce(words, no_words()), stop_words or [])


def drop_words(words: Column, stop_words: list[str]) -> Column:
    """Remove stop words from a token array, keeping order and repeats."""
    if not stop_words:
        return words
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(words, lambda w: ~F.array_contains(stops, w))


def keywords(text: Column, min_length: int = 2) -> Column:
    """Tokens of at least ``min_length`` characters, repeats kept."""
    return F.filter(tokens(text), lambda w: F.char_length(w) >= min_length)


def set_similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of two token arrays taken as sets."""

    def of(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        shared = F.size(F.array_intersect(a, b)).cast("double")
        return (
            F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
            .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
            .otherwise(bind(shared, lambda s: s / (F.size(a) + F.size(b) - s)))
        )

    pair = F.struct(F.array_distinct(left).alias("a"), F.array_distinct(right).alias("b"))
    return bind(pair, of)


def text_similarity(left: Column, right: Column) -> Column:
    """Similarity of two texts by shared keywords; 0.0 if either is empty."""
    return F.when(is_blank(left) | is_blank(right), 0.0).otherwise(
        set_similarity(keywords(left), keywords(right))
    )


def sentences(text: Column) -> Column:
    """Sentences by runs of ``.!?``; a Thai text is cut at white space."""
    edges = rf"^[{SPACE}]+|[{SPACE}]+$"
    latin = F.transform(F.split(text, "[.!?]+", -1), lambda s: F.regexp_replace(s, edges, ""))
    thai = F.split(text, f"[{SPACE}]+", -1)
    parts = F.when(detect_language(text) == "th", thai).otherwise(latin)
    return F.coalesce(F.filter(parts, lambda s: s != ""), no_words())


def count_words(text: Column) -> Column:
    """Struct of word, character and sentence counts and the mean word length.

    Marks at both ends of a word do not count for its length. The mean is left
    unrounded in ``word_length`` for further use.
    """
    given = F.coalesce(text, F.lit(""))
    words = F.regexp_count(given, F.lit(f"{NOT_SPACE}+"))
    outer = (
        rf"(?<!{NOT_SPACE}){_EDGE_MARKS}++"
        rf"|(?<!{_EDGE_MARKS}){_EDGE_MARKS}++(?!{NOT_SPACE})"
        rf"|[{SPACE}]++"
    )
    inner = F.char_length(F.regexp_replace(given, outer, ""))

    def record(n: Column) -> Column:
        mean = F.when(n["w"] > 0, n["c"] / n["w"]).otherwise(0.0)
        return F.struct(
            n["w"].alias("word_count"),
            F.char_length(given).alias("character_count"),
            F.char_length(F.replace(given, F.lit(" "), F.lit(""))).alias(
                "character_count_no_spaces"
            ),
            F.regexp_count(given, F.lit("[.!?]+")).alias("sentence_count"),
            F.bround(mean, 2).alias("average_word_length"),
            mean.alias("word_length"),
        )

    return bind(F.struct(words.alias("w"), inner.alias("c")), record)


def script_flags(text: Column) -> Column:
    """Struct ``language_detected, contains_thai, contains_english``."""
    thai = F.coalesce(text.rlike(f"[{_THAI}]"), F.lit(False))
    english = F.coalesce(text.rlike("[a-zA-Z]"), F.lit(False))
    name = (
        F.when(thai & english, "mixed")
        .when(thai, "thai")
        .when(english, "english")
        .otherwise("unknown")
    )
    return F.struct(
        name.alias("language_detected"),
        thai.alias("contains_thai"),
        english.alias("contains_english"),
    )


def counted_words(text: Column) -> Column:
    """Words for frequency counts: cut at space, stripped of marks, over 2 characters."""
    bare = F.regexp_replace(F.lower(text), f"[^{WORD}{SPACE}]", "")
    return F.coalesce(
        F.regexp_extract_all(bare, F.lit(rf"[{WORD}]{{3,}}"), F.lit(0)), no_words()
    )


def top_words(text: Column, limit: int = 5) -> Column:
    """The most frequent words of a text as ``array<struct<word,count>>``.

    Ties go to the word seen first. Everything happens inside the row: words
    are sorted with their positions and counted by run, so no text is shuffled.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(ordered)),
            lambda i: (i == 1)
            | (F.element_at(ordered, i)["w"] != F.element_at(ordered, F.greatest(i - 1, F.lit(1)))["w"]),
        )

        def count(begin: Column) -> Column:
            after = F.concat(
                F.slice(begin, F.lit(2), F.size(begin)), F.array(F.size(ordered) + 1)
            )
            return F.zip_with(
                begin,
                after,
                lambda b, e: F.struct(
                    (b - e).alias("less"),
                    F.element_at(ordered, b)["p"].alias("p"),
                    F.element_at(ordered, b)["w"].alias("w"),
                ),
            )

        return F.when(F.size(ordered) == 0, empty_array("struct<less:int,p:int,w:string>")).otherwise(
            bind(starts, count)
        )

    placed = F.transform(
        counted_words(text), lambda w, i: F.struct(w.alias("w"), i.cast("int").alias("p"))
    )
    ranked = F.slice(F.sort_array(bind(F.sort_array(placed), runs)), 1, limit)
    return F.transform(ranked, lambda r: F.struct(r["w"].alias("word"), (-r["less"]).alias("count")))


def readability(stats: Column) -> Column:
    """Struct of readability name and mean sentence length from :func:`count_words`."""
    length = F.when(stats["sentence_count"] > 0, stats["word_count"] / stats["sentence_count"]).otherwise(0.0)
    word = stats["average_word_length"]
    name = (
        F.when(stats["character_count"] == 0, "unknown")
        .when((word < 4) & (length < 15), "easy")
        .when((word < 6) & (length < 20), "medium")
        .otherwise("difficult")
    )
    return F.struct(
        name.alias("readability_score"),
        F.bround(length, 2).alias("average_sentence_length"),
        length.alias("sentence_length"),
    )


def analyze_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add counts, script, most common words and readability of a text column."""
    text = F.col(text_col)
    counted = df.withColumn("basic_stats", count_words(text))
    flags, level = script_flags(text), readability(F.col("basic_stats"))
    return counted.select(
        "*",
        flags["language_detected"].alias("language_detected"),
        flags["contains_thai"].alias("contains_thai"),
        flags["contains_english"].alias("contains_english"),
        top_words(text).alias("most_common_words"),
        level["readability_score"].alias("readability_score"),
        level["average_sentence_length"].alias("average_sentence_length"),
    )


def word_frequency(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Corpus-wide word counts; partial sums keep the shuffle at one row per word and task."""
    words = explode_rows(df, [], counted_words(F.col(text_col)), "word")
    return words.groupBy("word").agg(F.count("*").alias("count"))
