"""Checks of questions and answers as response columns.

A check is a function of a :class:`TextView` (and, for answers, of question and
context) that returns a :class:`Verdict`; :func:`add_check` turns it into a column
holding the struct of ``schemas.RESPONSE``. All of them are plain expressions, so
they run the same in batch and in streaming.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions import text as tx
from ragspark.functions.arrays import bind, empty_array
from ragspark.functions.patterns import ENDS_WORD, STARTS_WORD, WORD, sequence_groups, to_jvm_folded
from ragspark.operators import rules

PASS, FAIL, WARNING = "pass", "fail", "warning"
_SKIPPED = "Validation skipped (disabled)"
_SKIPPED_OR_EMPTY = "Validation skipped (disabled or empty input)"
_PARTS = ("lower", "folded", "words")
_THAI_CHAR = re.compile("[฀-๿]")


@dataclass(frozen=True)
class TextView:
    """A text with the derived forms that several checks share."""

    text: Column
    lower: Column
    folded: Column
    words: Column

    @staticmethod
    def of(text: Column) -> TextView:
        return TextView(text, F.lower(text), tx.fold_case(F.lower(text)), word_line(text))


@dataclass(frozen=True)
class Exchange:
    """What an answer check sees."""

    answer: TextView
    question: Column
    context: Column = field(default_factory=lambda: F.lit(None).cast("string"))


@dataclass(frozen=True)
class Verdict:
    """Evidence found in a text, and the response it leads to.

    They are kept apart so that a frame can hold the evidence as a column: a response
    refers to it many times, and a lambda around it would keep the searches out of
    generated code.
    """

    evidence: Column
    respond: Callable[[Column], Column]

    @property
    def column(self) -> Column:
        return self.respond(self.evidence)


def add_check(
    df: DataFrame, name: str, verdict: Verdict | Column, unless: Column | None = None
) -> DataFrame:
    """Add a response column; it is null, and nothing is evaluated, where ``unless`` holds."""

    def when(value: Column) -> Column:
        return value if unless is None else F.when(~unless, value)

    if isinstance(verdict, Column):
        return df.withColumn(name, when(verdict))
    evidence = f"{name}_evidence"
    held = df.withColumn(evidence, when(verdict.evidence))
    return held.withColumn(name, when(verdict.respond(F.col(evidence)))).drop(evidence)


def word_line(text: Column) -> Column:
    """Lower-cased words joined by single spaces, with a space at both ends.

    ``contains(line, ' word ')`` then tests a whole word by a byte search,
    without building a token array.
    """
    lower = F.lower(text)
    latin = F.regexp_replace(lower, f"[^{WORD}]+", " ")
    thai = F.regexp_replace(lower, rf"[^{WORD}\p{{M}}]+", " ")
    line = F.when(tx.detect_language(text) == "th", thai).otherwise(latin)
    return F.concat(F.lit(" "), line, F.lit(" "))


def prepare(df: DataFrame, text_col: str, name: str) -> tuple[DataFrame, TextView]:
    """Add the derived forms of ``text_col`` as columns, so each is computed once."""
    text = F.col(text_col)
    lower, folded, words = (f"__{name}_{part}" for part in _PARTS)
    out = df.withColumns({lower: F.lower(text), words: word_line(text)})
    out = out.withColumn(folded, tx.fold_case(F.col(lower)))
    return out, TextView(text, F.col(lower), F.col(folded), F.col(words))


def response(
    name: str, result: Column, message: Column, confidence: Column, metadata: Column | None = None
) -> Column:
    if metadata is None:
        metadata = F.lit(None).cast("string")
    return F.struct(
        F.lit(name).alias("validator"),
        result.alias("result"),
        message.alias("message"),
        confidence.cast("double").alias("confidence"),
        metadata.alias("metadata"),
    )


def skipped(name: str, message: str = _SKIPPED) -> Verdict:
    return Verdict(
        F.lit(None).cast("string"),
        lambda _: response(name, F.lit(PASS), F.lit(message), F.lit(1.0)),
    )


def is_passed(resp: Column) -> Column:
    return resp["result"] == PASS


def is_failed(resp: Column) -> Column:
    return resp["result"] == FAIL


def is_warning(resp: Column) -> Column:
    return resp["result"] == WARNING


def matching(view: TextView, patterns: list[str], multiline: bool = False) -> Column:
    """The patterns found in the text, in list order."""
    return listed((_found(view, p, multiline), F.lit(p)) for p in patterns)


def listed(items: Iterable[tuple[Column, Column]], kind: str = "string") -> Column:
    """Array of the values whose condition holds, without a lambda."""
    parts = [
        F.when(hit, F.array(value)).otherwise(empty_array(kind)) for hit, value in items
    ]
    return F.concat(*parts) if parts else empty_array(kind)


def _found(view: TextView, pattern: str, multiline: bool) -> Column:
    """Search for a pattern; a sequence of word groups only where all of them occur."""
    whole = view.folded.rlike(to_jvm_folded(pattern, multiline))
    for group in sequence_groups(pattern) or []:
        whole = view.folded.rlike(f"(?d){group}") & whole
    return whole


def pattern_words(pattern: str) -> list[str]:
    """Words left of a pattern once its punctuation is blanked.

    The backslash goes first, so ``\\b`` leaves a word ``b`` that a text must
    hold as well. Results rest on it; ``match="any"`` reads the pattern as the
    alternation it looks like.
    """
    return list(dict.fromkeys(re.findall(r"[^\W]+[฀-๿]*|[฀-๿]+",
                                         re.sub(r"[\\|*+?()\[\]{}.^$]", " ", pattern).lower())))


def holds_words(view: TextView, words: list[str]) -> Column:
    """All words occur; a Thai word is tested as a substring, for want of word breaks."""
    if not words:
        return F.lit(False)
    hit = F.lit(True)
    for word in words:
        if _THAI_CHAR.search(word):
            hit = hit & F.contains(view.lower, F.lit(word))
        else:
            hit = hit & F.contains(view.words, F.lit(f" {word} "))
    return hit


def holds_phrase(view: TextView, phrase: str) -> Column:
    """Word-bag test of a phrase; a Thai phrase is tested as a substring."""
    phrase = phrase.lower()
    if _THAI_CHAR.search(phrase):
        return F.contains(view.lower, F.lit(phrase))
    return holds_words(view, list(dict.fromkeys(re.findall(r"\w+", phrase))))


def _by_match(view: TextView, pattern: str, match: str) -> Column:
    if match == "all":
        return holds_words(view, pattern_words(pattern))
    if match == "any":
        return view.folded.rlike(to_jvm_folded(pattern))
    raise ValueError(f"match must be 'all' or 'any', not {match!r}")


def prompt_injection(
    view: TextView,
    patterns: list[str] | None = None,
    threshold: float = 0.8,
    enabled: bool = True,
) -> Verdict:
    name = "PromptInjectionValidator"
    if not enabled:
        return skipped(name, _SKIPPED_OR_EMPTY)
    patterns = rules.INJECTION if patterns is None else patterns
    blank = tx.is_blank(view.text)

    def respond(found: Column) -> Column:
        hit = F.size(found) > 0
        return response(
            name,
            F.when(hit, FAIL).otherwise(PASS),
            F.when(blank, _SKIPPED_OR_EMPTY)
            .when(hit, "Potential prompt injection detected")
            .otherwise("No prompt injection detected"),
            F.when(blank, 1.0).when(hit, threshold).otherwise(0.9),
            F.when(hit, F.to_json(F.struct(found.alias("detected_patterns")))),
        )

    return Verdict(matching(view, patterns, multiline=True), respond)


def _length(name: str, word: str, text: Column, low: int, high: int) -> Verdict:
    blank = tx.is_blank(text)

    def respond(size: Column) -> Column:
        return response(
            name,
            F.when(blank | (size < low) | (size > high), FAIL).otherwise(PASS),
            F.when(blank, f"{word} is empty")
            .when(size < low, f"{word} too short (minimum: {low} characters)")
            .when(size > high, f"{word} too long (maximum: {high} characters)")
            .otherwise(
                F.concat(F.lit(f"{word} length valid ("), size.cast("string"), F.lit(" characters)"))
            ),
            F.lit(1.0),
            F.when(~blank, F.to_json(F.struct(size.alias(f"{word.lower()}_length")))),
        )

    return Verdict(F.char_length(text), respond)


def input_length(
    view: TextView, max_length: int = 1000, min_length: int = 1, enabled: bool = True
) -> Verdict:
    name = "InputLengthValidator"
    return _length(name, "Input", view.text, min_length, max_length) if enabled else skipped(name)


def output_length(
    view: TextView, max_length: int = 2000, min_length: int = 5, enabled: bool = True
) -> Verdict:
    name = "OutputLengthValidator"
    return _length(name, "Output", view.text, min_length, max_length) if enabled else skipped(name)


def _profanity(name: str, found: Column, blank: Column, severity: str, hit_text: str, clean_text: str) -> Verdict:
    def respond(got: Column) -> Column:
        hit = F.size(got) > 0
        return response(
            name,
            F.when(hit, FAIL if severity == "fail" else WARNING).otherwise(PASS),
            F.when(blank, _SKIPPED_OR_EMPTY).when(hit, hit_text).otherwise(clean_text),
            F.when(blank, 1.0).when(hit, 0.8).otherwise(0.9),
            F.when(hit, F.to_json(F.struct(got.alias("detected_patterns")))),
        )

    return Verdict(found, respond)


def profanity(
    view: TextView,
    patterns: list[str] | None = None,
    severity: str = "warning",
    enabled: bool = True,
) -> Verdict:
    """Any severity other than ``fail`` gives a warning."""
    name = "ProfanityValidator"
    if not enabled:
        return skipped(name, _SKIPPED_OR_EMPTY)
    found = matching(view, rules.PROFANITY if patterns is None else patterns)
    return _profanity(
        name, found, tx.is_blank(view.text), severity,
        "Inappropriate content detected", "No inappropriate content detected",
    )


def token_profanity(
    view: TextView,
    patterns: list[str] | None = None,
    severity: str = "warning",
    enabled: bool = True,
    match: str = "all",
) -> Verdict:
    """Profanity by word sets instead of regexes; see :func:`pattern_words`."""
    name = "NLPEnhancedProfanityValidator"
    if not enabled:
        return skipped(name, _SKIPPED_OR_EMPTY)
    patterns = rules.PROFANITY if patterns is None else patterns
    found = listed((_by_match(view, p, match), F.lit(p)) for p in patterns)
    return _profanity(
        name, found, tx.is_blank(view.text), severity,
        "Profanity detected", "No profanity detected",
    )


def toxicity_level(pattern: str) -> float:
    for level, words in rules.TOXICITY_LEVELS:
        if any(w in pattern for w in words):
            return level
    return rules.TOXICITY_OTHER


def toxicity(
    view: TextView,
    patterns: list[str] | None = None,
    threshold: float = 0.7,
    enabled: bool = True,
    match: str = "all",
) -> Verdict:
    """Toxic content by pattern. ``all`` wants every word of a pattern, ``any`` one of them."""
    name = "ToxicityValidator"
    if not enabled:
        return skipped(name, _SKIPPED_OR_EMPTY)
    patterns = rules.TOXICITY if patterns is None else patterns
    hits = listed(
        (
            (
                _by_match(view, p, match),
                F.struct(F.lit(toxicity_level(p)).alias("level"), F.lit(p).alias("pattern")),
            )
            for p in patterns
        ),
        "struct<level:double,pattern:string>",
    )
    blank = tx.is_blank(view.text)

    def respond(found: Column) -> Column:
        hit = F.size(found) > 0
        level = F.array_max(found["level"])
        return response(
            name,
            F.when(hit & (level >= threshold), FAIL).when(hit, WARNING).otherwise(PASS),
            F.when(blank, _SKIPPED_OR_EMPTY)
            .when(hit & (level >= threshold), "Toxic content detected")
            .when(hit, "Potentially inappropriate content detected")
            .otherwise("No toxic content detected"),
            F.when(blank, 1.0).when(hit, level).otherwise(0.9),
            F.when(
                hit,
                F.to_json(
                    F.struct(
                        found["pattern"].alias("detected_patterns"),
                        level.alias("severity_score"),
                    )
                ),
            ),
        )

    return Verdict(hits, respond)


def hate_speech(
    view: TextView,
    patterns: list[str] | None = None,
    protected: list[str] | None = None,
    threshold: float = 0.8,
    enabled: bool = True,
    whole_word: bool = False,
) -> Verdict:
    """Hate patterns and protected terms.

    Terms count as substrings ("age" in "language") unless ``whole_word``.
    """
    name = "HateSpeechValidator"
    if not enabled:
        return skipped(name, _SKIPPED_OR_EMPTY)
    patterns = rules.HATE if patterns is None else patterns
    protected = rules.PROTECTED if protected is None else protected
    blank = tx.is_blank(view.text)

    def named(term: str) -> Column:
        if whole_word:
            return view.lower.rlike(STARTS_WORD + re.escape(term) + ENDS_WORD)
        return F.contains(view.lower, F.lit(term))

    terms = listed((named(t), F.lit(t)) for t in protected)

    def respond(f: Column) -> Column:
        n, m = F.size(f["p"]), F.size(f["t"])
        hit = (n > 0) | (m > 0)
        score = F.least(
            F.least(n * F.lit(0.3), F.lit(1.0)) + F.least(m * F.lit(0.2), F.lit(0.5)), F.lit(1.0)
        )
        return response(
            name,
            F.when(hit & (score >= threshold), FAIL).when(hit, WARNING).otherwise(PASS),
            F.when(blank, _SKIPPED_OR_EMPTY)
            .when(hit & (score >= threshold), "Hate speech detected")
            .when(hit, "Potentially discriminatory content detected")
            .otherwise("No hate speech detected"),
            F.when(blank, 1.0).when(hit, score).otherwise(0.9),
            F.when(
                hit,
                F.to_json(
                    F.struct(
                        f["p"].alias("detected_patterns"),
                        f["t"].alias("targeted_characteristics"),
                        score.alias("hate_score"),
                    )
                ),
            ),
        )

    return Verdict(F.struct(matching(view, patterns).alias("p"), terms.alias("t")), respond)


def relevance(
    pair: Exchange,
    min_relevance_score: float = 0.3,
    phrases: list[str] | None = None,
    enabled: bool = True,
    similarity: Callable[[Column, Column], Column] = tx.text_similarity,
) -> Verdict:
    """Fails on a declining phrase, warns below the score."""
    name = "RelevanceValidator"
    if not enabled:
        return skipped(name)
    phrases = rules.DECLINING if phrases is None else phrases
    missing = tx.is_blank(pair.answer.text) | tx.is_blank(pair.question)
    phrase = F.coalesce(
        F.lit(None).cast("string"),
        *[F.when(holds_phrase(pair.answer, p), F.lit(p)) for p in phrases],
    )

    def respond(f: Column) -> Column:
        declined, low = f["phrase"].isNotNull(), f["score"] < min_relevance_score
        shown = F.format_string("%.2f", F.bround(f["score"], 2))
        return response(
            name,
            F.when(missing | declined, FAIL).when(low, WARNING).otherwise(PASS),
            F.when(missing, "Missing answer or question for relevance check")
            .when(declined, F.concat(F.lit("Answer indicates inability to respond: '"), f["phrase"], F.lit("'")))
            .when(low, F.concat(F.lit("Low relevance score: "), shown))
            .otherwise(F.concat(F.lit("Relevance check passed (score: "), shown, F.lit(")"))),
            F.when(missing, 1.0).when(declined, 0.9).when(low, 0.7).otherwise(0.8),
            F.when(missing, F.lit(None).cast("string"))
            .when(declined, F.to_json(F.struct(f["phrase"].alias("detected_phrase"))))
            .otherwise(F.to_json(F.struct(f["score"].alias("relevance_score")))),
        )

    score = F.when(phrase.isNull(), similarity(pair.question, pair.answer.text))
    return Verdict(F.struct(phrase.alias("phrase"), score.alias("score")), respond)


def hallucination(
    pair: Exchange,
    confidence_threshold: float = 0.8,
    context_coverage_threshold: float = 0.3,
    uncertain: list[str] | None = None,
    invented: list[str] | None = None,
    enabled: bool = True,
    similarity: Callable[[Column, Column], Column] = tx.text_similarity,
) -> Verdict:
    """Warns on uncertain or invented phrases and on low overlap with the context."""
    name = "HallucinationValidator"
    if not enabled:
        return skipped(name)
    missing = tx.is_blank(pair.answer.text)
    notes = [
        (holds_phrase(pair.answer, p), F.lit(f"{label}: '{p}'"))
        for label, phrases in (
            ("Uncertainty phrase", rules.UNCERTAIN if uncertain is None else uncertain),
            ("Fabrication indicator", rules.INVENTED if invented is None else invented),
        )
        for p in phrases
    ]
    score = F.when(~tx.is_blank(pair.context), similarity(pair.answer.text, pair.context))
    coverage = bind(
        score,
        lambda s: F.when(
            s < context_coverage_threshold,
            F.array(
                F.concat(F.lit("Low context coverage: "), F.format_string("%.2f", F.bround(s, 2)))
            ),
        ).otherwise(empty_array("string")),
    )

    def respond(issues: Column) -> Column:
        hit = F.size(issues) > 0
        return response(
            name,
            F.when(missing, FAIL).when(hit, WARNING).otherwise(PASS),
            F.when(missing, "No answer provided for hallucination check")
            .when(hit, "Potential hallucination detected")
            .otherwise("No hallucination indicators detected"),
            F.when(missing, 1.0).when(hit, confidence_threshold).otherwise(0.9),
            F.when(~missing & hit, F.to_json(F.struct(issues.alias("detected_issues")))),
        )

    return Verdict(F.concat(listed(notes), coverage), respond)
