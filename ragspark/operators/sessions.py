"""Chat sessions, question/answer pairs and the query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.patterns import SPACE
from ragspark.operators import rules
from ragspark.operators.hotkeys import salted_join
from ragspark.operators.ordering import number_rows, with_neighbours


def session_questions(
    df: DataFrame,
    session: str,
    order: str,
    text: str,
    exit_words: list[str] | None = None,
) -> DataFrame:
    """Questions of each session up to its first exit word, numbered, blanks left out.

    The exit is a partial minimum per session, so no session is sorted as a whole.
    """
    words = rules.EXIT_WORDS if exit_words is None else exit_words
    edges = rf"^[{SPACE}]+|[{SPACE}]+$"
    rows = df.withColumn("question", F.regexp_replace(F.col(text), edges, ""))
    ends = rows.groupBy(session).agg(
        F.min(F.when(F.lower("question").isin(words), F.col(order))).alias("__end")
    )
    kept = (
        salted_join(rows.filter(F.col(session).isNotNull()), ends, [session], "inner", F.xxhash64(session, order))
        .filter(F.col("__end").isNull() | (F.col(order) < F.col("__end")))
        .filter(F.col("question") != "")
        .drop("__end")
    )
    return number_rows(kept, [session], order, "question_no", "total_questions")


def answer_pairs(
    df: DataFrame,
    session: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """User turns directly followed by an assistant turn, with the turn before as context."""
    near = with_neighbours(df, [session], order, [role, text])
    return near.filter((F.col(role) == "user") & (F.col("following")[role] == "assistant")).select(
        session,
        order,
        F.col(text).alias("question"),
        F.col("following")[text].alias("answer"),
        F.col("previous")[text].alias("context"),
    )


def document_summary(text: Column, metadata: Column, score: Column | None = None) -> Column:
    """Struct of a retrieved text for the log: 200 characters, length, metadata, score."""
    short = F.when(
        F.char_length(text) > 200, F.concat(F.left(text, F.lit(200)), F.lit("..."))
    ).otherwise(text)
    return F.struct(
        short.alias("content"),
        metadata.alias("metadata"),
        (F.lit(None).cast("double") if score is None else score.cast("double")).alias("score"),
        F.char_length(text).alias("length"),
    )


def document_averages(queries: DataFrame, retrieved: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``num_retrieved_docs`` and ``avg_doc_length`` per query; a query without documents has 0."""
    per_query = retrieved.groupBy(key).agg(
        F.count("*").alias("__n"), F.sum(F.char_length(text)).alias("__chars")
    )
    n, chars = F.coalesce("__n", F.lit(0)), F.coalesce("__chars", F.lit(0))
    return queries.join(per_query, key, "left").select(
        *[queries[c] for c in queries.columns],
        n.alias("num_retrieved_docs"),
        (chars / F.greatest(n, F.lit(1))).alias("avg_doc_length"),
    )


def query_log(
    df: DataFrame,
    config: dict[str, str],
    question: str = "question",
    answer: str = "answer",
    user_id: Column | None = None,
    session_id: Column | None = None,
    timestamp: Column | None = None,
    latency: Column | None = None,
    docs: Column | None = None,
) -> DataFrame:
    """One log row per query: parameters, configuration, metrics and artifacts.

    ``docs`` is an array of :func:`document_summary` structs.
    """
    q, a = F.col(question), F.col(answer)
    none = F.lit(None).cast("string")
    user = none if user_id is None else user_id.cast("string")
    when = F.current_timestamp().cast("string") if timestamp is None else timestamp.cast("string")
    defaults = {"prompt_template_version": "latest", "tools_enabled": "false", "num_tools": "0"}
    settings = {**defaults, **{k: str(v) for k, v in config.items() if v is not None}}
    settings["execution_mode"] = "agent" if settings["tools_enabled"].lower() == "true" else "chain"
    lengths = F.array() if docs is None else docs["length"]
    n = F.lit(0) if docs is None else F.size(docs)
    chars = F.lit(0) if docs is None else F.aggregate(lengths, F.lit(0), lambda acc, x: acc + x)
    pair = F.to_json(
        F.struct(q.alias("question"), a.alias("answer"), when.alias("timestamp"), user.alias("user_id")),
        {"ignoreNullFields": "false"},
    )
    return df.select(
        "*",
        F.left(q, F.lit(500)).alias("logged_question"),
        F.char_length(q).alias("question_length"),
        F.coalesce(F.when(user != "", user), F.lit("anonymous")).alias("user"),
        F.coalesce(none if session_id is None else session_id.cast("string"), F.lit("default")).alias("session"),
        when.alias("logged_at"),
        *[F.lit(v).alias(k) for k, v in settings.items()],
        (F.lit(None).cast("double") if latency is None else latency.cast("double")).alias("latency_seconds"),
        n.alias("num_retrieved_docs"),
        F.char_length(a).alias("answer_length"),
        (chars / F.greatest(n, F.lit(1))).alias("avg_doc_length"),
        (none if docs is None else F.when(n > 0, F.to_json(docs, {"ignoreNullFields": "false"}))).alias("retrieved_docs"),
        pair.alias("qa_pair"),
    )
