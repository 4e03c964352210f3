"""Configured check runs over questions, answers and contexts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark import schemas
from ragspark.functions.arrays import explode_rows
from ragspark.operators import checks as ck
from ragspark.operators.pii import pii_check

MAX_WARNINGS = 2


# Defaults of the configuration sections.
@dataclass(frozen=True)
class InputValidation:
    enabled: bool = True
    check_prompt_injection: bool = True
    prompt_injection_threshold: float = 0.8
    max_length: int = 1000
    min_length: int = 1
    check_profanity: bool = True
    profanity_severity: str = "warning"


@dataclass(frozen=True)
class OutputValidation:
    enabled: bool = True
    max_response_length: int = 2000
    min_response_length: int = 5
    check_relevance: bool = True
    relevance_threshold: float = 0.6
    check_hallucination: bool = True
    hallucination_threshold: float = 0.8


@dataclass(frozen=True)
class ContentSafety:
    enabled: bool = True
    toxicity_threshold: float = 0.7
    hate_speech_threshold: float = 0.8
    toxicity_match: str = "all"


@dataclass(frozen=True)
class PiiDetection:
    enabled: bool = True
    mask_pii: bool = True
    allowed_pii_types: tuple[str, ...] = ()
    fail_on_pii: bool = False
    custom_patterns: dict[str, str] | None = None
    enabled_types: tuple[str, ...] | None = None


def _section(kind: type, values: dict[str, Any] | None) -> Any:
    """Known keys only; unknown ones are ignored. Shares must be in [0, 1], lengths sound."""
    known = {f.name for f in fields(kind)}
    given = {k: v for k, v in (values or {}).items() if k in known}
    for key, value in given.items():
        if key.endswith("threshold") and not 0 <= float(value) <= 1:
            raise ValueError(f"{key} must be between 0 and 1")
        if key.startswith("max_") and int(value) <= 0:
            raise ValueError(f"{key} must be positive")
        if key.startswith("min_") and int(value) < 0:
            raise ValueError(f"{key} must not be negative")
    return kind(**given)


@dataclass(frozen=True)
class Check:
    """A named check."""

    name: str
    build: Callable[[Any], ck.Verdict | Column]


class GuardrailPlan:
    """Ordered checks per stage, built from a configuration once, on the driver."""

    def __init__(self, config: dict[str, Any] | None = None) -> None:
        config = config or {}
        self.enabled = bool(config.get("enabled", True))
        self.input_validation = _section(InputValidation, config.get("input_validation"))
        self.output_validation = _section(OutputValidation, config.get("output_validation"))
        self.content_safety = _section(ContentSafety, config.get("content_safety"))
        self.pii_detection = _section(PiiDetection, config.get("pii_detection"))
        self.input_checks: list[Check] = []
        self.output_checks: list[Check] = []
        self.context_checks: list[Check] = []
        if self.enabled:
            self._build()

    def _build(self) -> None:
        asked, answered = self.input_validation, self.output_validation
        if asked.enabled:
            if asked.check_prompt_injection:
                self.input_checks.append(
                    Check(
                        "PromptInjectionValidator",
                        lambda v: ck.prompt_injection(v, threshold=asked.prompt_injection_threshold),
                    )
                )
            self.input_checks.append(
                Check(
                    "InputLengthValidator",
                    lambda v: ck.input_length(v, asked.max_length, asked.min_length),
                )
            )
            if asked.check_profanity:
                self.input_checks.append(
                    Check(
                        "ProfanityValidator",
                        lambda v: ck.profanity(v, severity=asked.profanity_severity),
                    )
                )
        if answered.enabled:
            self.output_checks.append(
                Check(
                    "OutputLengthValidator",
                    lambda x: ck.output_length(
                        x.answer, answered.max_response_length, answered.min_response_length
                    ),
                )
            )
            if answered.check_relevance:
                self.output_checks.append(
                    Check(
                        "RelevanceValidator",
                        lambda x: ck.relevance(x, answered.relevance_threshold),
                    )
                )
            if answered.check_hallucination:
                self.output_checks.append(
                    Check(
                        "HallucinationValidator",
                        lambda x: ck.hallucination(x, answered.hallucination_threshold),
                    )
                )
        shared = []
        safe, pii = self.content_safety, self.pii_detection
        if safe.enabled:
            shared.append(
                Check(
                    "ToxicityValidator",
                    lambda v: ck.toxicity(
                        v, threshold=safe.toxicity_threshold, match=safe.toxicity_match
                    ),
                )
            )
            shared.append(
                Check(
                    "HateSpeechValidator",
                    lambda v: ck.hate_speech(v, threshold=safe.hate_speech_threshold),
                )
            )
        if pii.enabled:
            shared.append(
                Check(
                    "PIIDetector",
                    lambda v: pii_check(
                        v,
                        mask=pii.mask_pii,
                        allowed_types=list(pii.allowed_pii_types),
                        fail_on_pii=pii.fail_on_pii,
                        custom_patterns=pii.custom_patterns,
                        enabled_types=None if pii.enabled_types is None else list(pii.enabled_types),
                    ),
                )
            )
        self.input_checks += shared
        self.output_checks += [
            Check(c.name, lambda x, c=c: c.build(x.answer)) for c in shared
        ]

    def add_input_check(self, name: str, build: Callable[[ck.TextView], ck.Verdict | Column]) -> None:
        """Append a custom check of the question."""
        self.input_checks.append(Check(name, build))

    def add_output_check(self, name: str, build: Callable[[ck.Exchange], ck.Verdict | Column]) -> None:
        """Append a custom check of the answer."""
        self.output_checks.append(Check(name, build))

    def add_context_check(self, name: str, build: Callable[[ck.TextView], ck.Verdict | Column]) -> None:
        """Append a custom check of the context; none is built in."""
        self.context_checks.append(Check(name, build))

    def validate_input(self, df: DataFrame, question: str = "question") -> DataFrame:
        """Add ``is_valid`` and ``results``; more than two warnings make a question invalid."""
        ready, view = ck.prepare(df, question, "in")
        return _run(ready, self.input_checks, view, MAX_WARNINGS).select(
            *df.columns, "is_valid", "results"
        )

    def validate_output(
        self,
        df: DataFrame,
        answer: str = "answer",
        question: str = "question",
        context: str | None = "context",
    ) -> DataFrame:
        """Add ``is_valid`` and ``results``; warnings alone never make an answer invalid."""
        ready, view = ck.prepare(df, answer, "out")
        about = F.lit(None).cast("string") if context is None else F.col(context)
        pair = ck.Exchange(view, F.col(question), about)
        return _run(ready, self.output_checks, pair, None).select(
            *df.columns, "is_valid", "results"
        )

    def validate_context(
        self, hits: DataFrame, key: str, order: str = "rank", text: str = "text"
    ) -> DataFrame:
        """Per ``key``: its texts joined by line feeds in ``order``, ``is_valid``, ``results``.

        A key holds the k texts retrieved for one question.
        """
        listed = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(text).alias("text"))))
        joined = hits.groupBy(key).agg(F.array_join(listed["text"], "\n").alias("context_text"))
        ready, view = ck.prepare(joined, "context_text", "ctx")
        return _run(ready, self.context_checks, view, None).select(
            key, "context_text", "is_valid", "results"
        )

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: the switch and the check names per stage."""
        row = [self.enabled] + [
            [c.name for c in stage]
            for stage in (self.input_checks, self.output_checks, self.context_checks)
        ]
        return spark.createDataFrame(
            [row],
            "enabled boolean, input_validators array<string>, output_validators array<string>, "
            "context_validators array<string>",
        )


def _run(df: DataFrame, checks: list[Check], given: Any, max_warnings: int | None) -> DataFrame:
    """Results up to and including the first fail; a failed row skips all later checks.

    A check is a column, null where it was skipped, and knows of the ones before it by one flag. The columns are put
    together once.
    """
    out, failed = df, None
    for i, check in enumerate(checks):
        out = ck.add_check(out, f"__c{i}", check.build(given), failed)
        now = F.coalesce(ck.is_failed(F.col(f"__c{i}")), F.lit(False))
        out = out.withColumn(f"__f{i}", now if failed is None else failed | now)
        failed = F.col(f"__f{i}")
    made = F.array(*[F.col(f"__c{i}") for i in range(len(checks))]) if checks else F.array()
    results = F.filter(made.cast(f"array<{schemas.RESPONSE}>"), lambda r: r.isNotNull())
    out = out.withColumn("results", results)
    valid = F.lit(True) if failed is None else ~failed
    if max_warnings is not None:
        valid = valid & (F.size(F.filter("results", ck.is_warning)) <= max_warnings)
    return out.withColumn("is_valid", valid)


def report(results: Column) -> Column:
    """Struct of status, counts and details of one run; missing metadata reads ``{}``."""
    n = F.size(results)

    def count(kind: str) -> Column:
        return F.size(F.filter(results, lambda r: r["result"] == kind))

    details = F.transform(
        results,
        lambda r: F.struct(
            r["result"].alias("result"),
            r["message"].alias("message"),
            r["confidence"].alias("confidence"),
            F.coalesce(r["metadata"], F.lit("{}")).alias("metadata"),
        ),
    )
    status = (
        F.when(n == 0, "no_validations")
        .when(count("fail") > 0, "failed")
        .when(count("warning") > 0, "warning")
        .otherwise("passed")
    )
    return F.struct(
        status.alias("status"),
        n.alias("total_checks"),
        count("pass").alias("passed"),
        count("fail").alias("failed"),
        count("warning").alias("warnings"),
        details.alias("details"),
    )


def report_counts(df: DataFrame, results: str = "results") -> DataFrame:
    """Corpus report: runs per check and result."""
    one = explode_rows(df, [], F.col(results), "r")
    return one.groupBy(F.col("r.validator").alias("validator"), F.col("r.result").alias("result")).agg(
        F.count("*").alias("runs")
    )
