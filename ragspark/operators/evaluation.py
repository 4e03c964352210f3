"""Retrieval and answer quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark import schemas
from ragspark.functions import text as tx
from ragspark.functions import vectors as vec
from ragspark.operators.retrieval import render, top_k

ANSWER_METRICS = ["relevance", "coherence", "accuracy", "overall_quality"]
RAG_METRICS = ["answer_relevance", "context_relevance", "accuracy", "overall_quality"]

ANSWER_PROMPT = (
    "Rate an answer to a question.\n\nQuestion: {question}\n\nAnswer: {answer}\n\n"
    "Reference answer: {reference}\n\n"
    "Score from 1 to 10: relevance (does it address the question), coherence (is it clear and "
    "well structured), accuracy (does it agree with the reference), overall_quality.\n"
    'Reply with JSON only: {{"relevance": n, "coherence": n, "accuracy": n, "overall_quality": n}}'
)
RAG_PROMPT = (
    "Rate the response of a retrieval system.\n\nQuestion: {question}\n\nContext: {context}\n\n"
    "Answer: {answer}\n\nReference answer: {reference}\n\n"
    "Score from 1 to 10: answer_relevance (answer to question), context_relevance (context to "
    "question), accuracy (does it agree with the reference), overall_quality.\n"
    'Reply with JSON only: {{"answer_relevance": n, "context_relevance": n, "accuracy": n, '
    '"overall_quality": n}}'
)


def chunk_relevance(
    hits: DataFrame,
    ideals: DataFrame,
    qid: str = "question_id",
    vid: str = "vec_id",
    hit_vector: str = "embedding",
    ideal_vector: str = "ideal_embedding",
) -> DataFrame:
    """``qid, vid, rank, relevance``: the best cosine to any ideal of the question, at least 0.

    ``ideals`` has one row per ideal context. Each of at most k hits meets the ideals
    of its own question only, and the maximum is partial before the shuffle.
    """
    pairs = hits.join(ideals.select(qid, F.col(ideal_vector).alias("__ideal")), qid, "left")
    near = F.coalesce(vec.cosine(F.col(hit_vector), F.col("__ideal")), F.lit(0.0))
    return pairs.groupBy(qid, vid, "rank").agg(
        F.greatest(F.max(near), F.lit(0.0)).alias("relevance")
    )


def retrieval_scores(
    questions: DataFrame,
    relevance: DataFrame,
    ideal_counts: DataFrame,
    threshold: float = 0.7,
    qid: str = "question_id",
) -> DataFrame:
    """Precision, recall, F1, mean relevance and hit count per question.

    A hit is relevant if strictly above the threshold. ``ideal_counts`` holds ``qid``
    and ``ideals``; a question without hits or ideals scores 0.
    """
    per = relevance.groupBy(qid).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("relevance") > threshold).alias("good"),
        F.avg("relevance").alias("mean"),
    )
    n, good = F.coalesce("n", F.lit(0)), F.coalesce("good", F.lit(0))
    ideals = F.coalesce("ideals", F.lit(0))
    return (
        questions.select(qid)
        .join(per, qid, "left")
        .join(ideal_counts.select(qid, "ideals"), qid, "left")
        .select(
            qid,
            F.when(n > 0, good / n).otherwise(0.0).alias("precision"),
            F.when(ideals > 0, F.least(good / ideals, F.lit(1.0))).otherwise(0.0).alias("recall"),
            F.coalesce("mean", F.lit(0.0)).alias("avg_relevance"),
            n.alias("retrieved_count"),
        )
        .withColumn("f1_score", f1(F.col("precision"), F.col("recall")))
    )


def f1(precision: Column, recall: Column) -> Column:
    return F.when(
        precision + recall > 0, F.lit(2.0) * precision * recall / (precision + recall)
    ).otherwise(0.0)


def retrieval_summary(scores: DataFrame) -> DataFrame:
    """One row: unweighted means over the questions and their number."""
    return scores.agg(
        F.avg("precision").alias("avg_precision"),
        F.avg("recall").alias("avg_recall"),
        F.avg("f1_score").alias("avg_f1_score"),
        F.avg("avg_relevance").alias("avg_relevance"),
        F.count("*").alias("total_queries"),
    )


def evaluate_retrieval(
    vectors: DataFrame,
    tests: DataFrame,
    k: int = 5,
    similarity_threshold: float = 0.7,
    embedder: vec.Embedder | None = None,
    qid: str = "question_id",
    vid: str = "vec_id",
) -> tuple[DataFrame, DataFrame]:
    """Per-question scores and their summary.

    ``tests`` has ``qid, question, ideal_context``; ``vectors`` has ``vid, embedding``.
    Every ideal text is embedded once, not once per pair.
    """
    asked = tests.select(qid, vec.embed(F.col("question"), embedder).alias("embedding"))
    hits = top_k(asked, vectors, k, qid, vid, carry=True)
    listed = tests.select(qid, F.explode("ideal_context").alias("ideal"))
    distinct = listed.select("ideal").distinct().select(
        "ideal", vec.embed(F.col("ideal"), embedder).alias("ideal_embedding")
    )
    ideals = listed.join(distinct, "ideal").select(qid, "ideal_embedding")
    counts = tests.select(qid, F.greatest(F.size("ideal_context"), F.lit(0)).alias("ideals"))
    scores = retrieval_scores(
        tests, chunk_relevance(hits, ideals, qid, vid, "vector"), counts, similarity_threshold, qid
    )
    return scores, retrieval_summary(scores)


def at_k(
    relevant: DataFrame, ks: list[int], totals: DataFrame, qid: str = "question_id"
) -> DataFrame:
    """Precision and recall per question for several K from one ranking.

    ``relevant`` has ``qid, rank, is_relevant``; ``totals`` has ``qid, total`` relevant ones.
    """
    counts = [F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in ks]
    goods = [F.count_if((F.col("rank") <= k) & F.col("is_relevant")).alias(f"g{k}") for k in ks]
    wide = totals.select(qid, "total").join(relevant.groupBy(qid).agg(*counts, *goods), qid, "left")
    long = wide.select(
        qid,
        "total",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("k"),
                        F.coalesce(f"n{k}", F.lit(0)).alias("n"),
                        F.coalesce(f"g{k}", F.lit(0)).alias("g"),
                    )
                    for k in ks
                ]
            )
        ).alias("at"),
    )
    return long.select(
        qid,
        F.col("at.k").alias("k"),
        F.when(F.col("at.n") > 0, F.col("at.g") / F.col("at.n")).otherwise(0.0).alias("precision_at_k"),
        F.when(F.col("total") > 0, F.col("at.g") / F.col("total")).otherwise(0.0).alias("recall_at_k"),
    )


def reciprocal_rank(relevant: DataFrame, questions: DataFrame, qid: str = "question_id") -> DataFrame:
    """One over the rank of the first relevant hit per question, 0 if there is none."""
    first = relevant.groupBy(qid).agg(
        F.min(F.when(F.col("is_relevant"), F.col("rank"))).alias("first")
    )
    return questions.select(qid).join(first, qid, "left").select(
        qid, F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank")
    )


def mean_reciprocal_rank(relevant: DataFrame, questions: DataFrame, qid: str = "question_id") -> DataFrame:
    return reciprocal_rank(relevant, questions, qid).agg(
        F.avg("reciprocal_rank").alias("mrr"), F.count("*").alias("total_queries")
    )


def answer_prompt(question: Column, answer: Column, reference: Column) -> Column:
    return render(F.lit(ANSWER_PROMPT), {"question": question, "answer": answer, "reference": reference})


def rag_prompt(question: Column, context: Column, answer: Column, reference: Column) -> Column:
    return render(
        F.lit(RAG_PROMPT),
        {"question": question, "context": context, "answer": answer, "reference": reference},
    )


def _parsed(reply: Column, ddl: str, metrics: list[str]) -> Column:
    """Scores of a JSON reply. An empty or broken reply is all zeros; a metric that a sound
    reply leaves out stays null, so that it does not count in a mean."""
    got = F.from_json(reply, ddl + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    sound = F.coalesce(F.trim(reply) != "", F.lit(False)) & got["_corrupt"].isNull()
    return F.struct(*[F.when(sound, got[m]).otherwise(0.0).alias(m) for m in metrics])


def parse_answer_scores(reply: Column) -> Column:
    return _parsed(reply, schemas.ANSWER_SCORES, ANSWER_METRICS)


def parse_rag_scores(reply: Column) -> Column:
    return _parsed(reply, schemas.RAG_SCORES, RAG_METRICS)


def similarity_scores(answer: Column, reference: Column) -> Column:
    """Model-free scores for offline use: ten times the keyword similarity in every metric."""
    score = F.lit(10.0) * tx.text_similarity(answer, reference)
    return F.struct(*[score.alias(m) for m in ANSWER_METRICS])


def evaluate_generation(
    tests: DataFrame,
    generator: Callable[[DataFrame], DataFrame],
    judge: Callable[[DataFrame], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answer every question, score the answers, and summarise.

    ``generator`` adds ``generated_answer`` to a frame with ``question``. ``judge`` maps the
    answered frame to a column of JSON replies; without it answers are compared by keywords.
    """
    answered = generator(tests.withColumn("ideal_answer", F.coalesce("ideal_answer", F.lit(""))))
    if judge is None:
        scores = similarity_scores(F.col("generated_answer"), F.col("ideal_answer"))
    else:
        scores = parse_answer_scores(judge(answered))
    results = answered.withColumn("__s", scores).select("*", "__s.*").drop("__s")
    return results, generation_summary(results)


def generation_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"avg_{m}") for m in ANSWER_METRICS],
        F.count("*").alias("total_queries"),
    )


def score_rag(responses: DataFrame, reply: Column) -> DataFrame:
    """Add the metrics of ``reply``; a row whose ``error`` is set has zeros."""
    scored = responses.withColumn("__s", parse_rag_scores(reply))
    return scored.select(
        *responses.columns,
        *[
            F.when(F.col("error").isNotNull(), 0.0).otherwise(F.col("__s")[m]).alias(m)
            for m in RAG_METRICS
        ],
    )


def evaluate_rag_system(
    tests: DataFrame,
    system: Callable[[DataFrame], DataFrame],
    judge: Callable[[DataFrame], Column],
) -> tuple[DataFrame, DataFrame]:
    """``system`` adds ``answer, context, sources, error`` to the questions."""
    answered = system(tests.withColumn("ideal_answer", F.coalesce("ideal_answer", F.lit(""))))
    results = score_rag(answered, judge(answered))
    return results, rag_summary(results)


def rag_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"avg_{m}") for m in RAG_METRICS],
        F.count("*").alias("total_queries"),
        F.count_if(F.col("error").isNull()).alias("successful_queries"),
    )
