"""One-call evaluations over a file of test cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions.text import text_similarity
from ragspark.functions.vectors import Embedder
from ragspark.operators import evaluation
from ragspark.sources.files import read_golden


def quick_retrieval_eval(
    vectors: DataFrame, path: str, k: int = 5, embedder: Embedder | None = None, vid: str = "chunk_id"
) -> tuple[DataFrame, DataFrame]:
    """Scores per question and their summary, against a vector table."""
    tests = read_golden(vectors.sparkSession, path)
    return evaluation.evaluate_retrieval(vectors, tests, k=k, embedder=embedder, vid=vid)


def quick_generation_eval(
    spark: SparkSession,
    generator: Callable[[DataFrame], DataFrame],
    path: str,
    judge: Callable[[DataFrame], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answer and score the questions; without a judge, keywords are compared."""
    return evaluation.evaluate_generation(read_golden(spark, path), generator, judge)


def quick_rag_eval(
    spark: SparkSession,
    system: Callable[[DataFrame], DataFrame],
    path: str,
    judge: Callable[[DataFrame], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run a whole system on the questions; without a judge, keywords are compared."""
    tests = read_golden(spark, path)
    return evaluation.evaluate_rag_system(tests, system, judge or _by_keywords)


def _by_keywords(answered: DataFrame) -> Column:
    """A reply in the judge's format, from keyword overlaps."""
    def score(a: str, b: str) -> Column:
        return F.lit(10.0) * text_similarity(F.col(a), F.col(b))

    accuracy = score("answer", "ideal_answer")
    return F.to_json(
        F.struct(
            score("answer", "question").alias("answer_relevance"),
            score("context", "question").alias("context_relevance"),
            accuracy.alias("accuracy"),
            accuracy.alias("overall_quality"),
        )
    )
