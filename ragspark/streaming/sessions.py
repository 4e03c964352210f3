"""Chat sessions on streams: question and answer pairs, and questions up to an exit word."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ragspark.functions.patterns import SPACE
from ragspark.operators import rules
from ragspark.operators.ordering import number_rows
from ragspark.streaming.batches import BatchLog

# What a turn may be of a pair.
_QUESTION, _ANSWER, _CONTEXT = range(3)
# Turns of a session whose pairs share a state.
_TURNS = 64


def answer_pairs_stream(
    turns: DataFrame,
    session: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    ts: str = "ts",
    within: str = "1 hour",
    delay: str = "10 minutes",
    first: int = 0,
) -> DataFrame:
    """User turns directly followed by an assistant turn, with the turn before as context, of a stream of turns.

    An answer comes ``within`` that time after its question, the context that time before it. The turns
    of a session are numbered without gaps from ``first``, whose context is null. Parts of a pair may come in any order and trigger; they are
    held until the watermark, ``delay`` behind the latest time, has passed them. A pair is written once, when its last part is there.

    Each turn goes to the places of the questions it may belong to, as question, answer or context, and the places of ``_TURNS`` turns of a
    session have one state: one store a partition and one shuffle, where joins of the stream with itself would keep four stores each.
    """
    timed = turns.withWatermark(ts, delay)
    place = F.col(order)
    as_part = lambda to, part: F.struct(to.alias("o"), F.lit(part).alias("part"))
    parts = F.array(
        F.when(F.col(role) == "user", as_part(place, _QUESTION)),
        F.when(F.col(role) == "assistant", as_part(place - 1, _ANSWER)),
        F.when(place + 1 > first, as_part(place + 1, _CONTEXT)),
    )
    span = F.expr(f"INTERVAL {within}")
    dealt = (
        timed.filter(F.col(session).isNotNull() & place.isNotNull() & F.col(ts).isNotNull())
        .select(F.col(session).alias("__s"), F.col(ts), F.col(text).alias("__text"), F.explode(parts).alias("__p"))
        .filter(F.col("__p.o") >= first)
        .select(
            "__s", F.col("__p.o").alias("__o"), F.col("__p.part").alias("__part"), "__text", F.col(ts),
            *[F.unix_micros(t.cast("timestamp")).alias(n) for n, t in (("__at", F.col(ts)), ("__since", F.col(ts) - span), ("__until", F.col(ts) + span))],
        )
    )
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    pairs = f"`{session}` {kinds['__s']}, `{order}` {kinds['__o']}, question string, answer string, context string"

    def meet(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {int(o): parts for o, parts in json.loads(state.get[0]).items()} if state.exists else {}
        fresh: dict[int, list[list]] = {}
        for frame in frames:
            columns = (frame[c].tolist() for c in ("__o", "__part", "__text", "__at", "__since", "__until"))
            for o, part, told, *times in zip(*columns):
                fresh.setdefault(o, [[], [], []])[part].append([*times, told if isinstance(told, str) else None])
        found = []
        for o, parts in fresh.items():
            old = held.get(o, [[], [], []])
            found += [(key[0], o, *texts) for texts in _meetings(old, parts, o == first)]
            held[o] = [a + b for a, b in zip(old, parts)]
        passed = state.getCurrentWatermarkMs() * 1000
        kept = {o: [[row for row in part if row[2] >= passed] for part in parts] for o, parts in held.items()}
        kept = {o: parts for o, parts in kept.items() if any(parts)}
        state.update((json.dumps(kept, ensure_ascii=False),))
        state.setTimeoutTimestamp(max(row[2] for parts in kept.values() for part in parts for row in part) // 1000 + 1)
        if found:
            yield pd.DataFrame(found, columns=[session, order, "question", "answer", "context"], dtype=object)

    grouped = dealt.withColumn("__block", F.floor(F.col("__o") / _TURNS)).groupBy("__s", "__block")
    return grouped.applyInPandasWithState(meet, pairs, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def _meetings(held: list[list], fresh: list[list], opening: bool) -> list[tuple]:
    """Texts of the questions, answers and contexts of a place that meet now, each a row of time, earliest and latest time of its partners, and text."""
    asked = [(q, True) for q in fresh[_QUESTION]] + [(q, False) for q in held[_QUESTION]]
    found = []
    for q, q_new in asked:
        for n, a in enumerate(held[_ANSWER] + fresh[_ANSWER]):
            if not q[0] <= a[0] <= q[2]:
                continue
            new = q_new or n >= len(held[_ANSWER])
            if opening:
                found += [(q[3], a[3], None)] if new else []
                continue
            before = (held[_CONTEXT] if new else []) + fresh[_CONTEXT]
            found += [(q[3], a[3], c[3]) for c in before if q[1] <= c[0] <= q[0]]
    return found


def session_questions_stream(
    turns: DataFrame,
    session: str,
    order: str,
    text: str,
    ts: str,
    path: str,
    checkpoint: str,
    exit_words: list[str] | None = None,
    timeout_seconds: float = 86_400,
    **trigger: object,
) -> StreamingQuery:
    """Write the questions of each session up to its first exit word, numbered, blanks left out, to a :class:`BatchLog` at ``path``.

    What is kept of a session is whether and where it ended, how many questions it had, and when it was last heard of; a session
    that is silent for ``timeout_seconds`` (of event time, which goes by the latest time seen) is forgotten, and begins anew if it speaks again. A
    micro-batch is decided by the batch operators, in as many tasks as its sessions need, and committed with the state by its
    number, so a repeated batch changes nothing. Turns of one session reach the stream in order; one that comes late is
    numbered after those that were there before, and dropped if the session had ended.
    """
    words = rules.EXIT_WORDS if exit_words is None else exit_words
    edges = rf"^[{SPACE}]+|[{SPACE}]+$"

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = BatchLog(spark, path)
        past = done.committed()
        if number in past:
            return
        kind = f"{session} {batch.schema[session].dataType.simpleString()}, __end {batch.schema[order].dataType.simpleString()}, __count long, __heard timestamp"
        if past:
            state = spark.read.schema(kind).parquet(done.folder("state", past[-1]))
        else:
            state = spark.createDataFrame([], kind)
        rows = batch.filter(F.col(session).isNotNull()).withColumn("question", F.regexp_replace(F.col(text), edges, ""))
        leaves = F.lower("question").isin(words)
        news = rows.groupBy(session).agg(F.min(F.when(leaves, F.col(order))).alias("__new_end"), F.max(ts).alias("__new_heard"))
        known = state.join(news, session, "full").select(
            session,
            # a session that had ended stays so, whatever comes
            F.coalesce("__end", "__new_end").alias("__end"),
            F.col("__end").isNotNull().alias("__over"),
            F.coalesce("__count", F.lit(0)).alias("__count"),
            F.greatest("__heard", "__new_heard").alias("__heard"),
        )
        at = done.folder("known", number)
        known.write.mode("overwrite").parquet(at)
        known = spark.read.schema(known.schema).parquet(at)
        open_ = known.filter("NOT __over").select(session, "__end", "__count")
        kept = rows.join(open_, session).filter((F.col("__end").isNull() | (F.col(order) < F.col("__end"))) & (F.col("question") != ""))
        numbered = number_rows(kept, [session], order, "question_no")
        out = numbered.withColumn("question_no", F.col("question_no") + F.col("__count")).select(*batch.columns, "question", "question_no")
        out.write.mode("overwrite").parquet(done.folder("data", number))
        counts = spark.read.schema(out.schema).parquet(done.folder("data", number)).groupBy(session).agg(F.count(F.lit(1)).alias("__more"))
        clock = known.agg(F.max("__heard")).first()[0]
        after = known.join(counts, session, "left").select(
            session, "__end", (F.col("__count") + F.coalesce("__more", F.lit(0))).alias("__count"), "__heard"
        )
        if clock is not None:
            after = after.filter(F.col("__heard") >= F.lit(clock) - F.expr(f"INTERVAL {float(timeout_seconds)} SECONDS"))
        after.write.mode("overwrite").parquet(done.folder("state", number))
        done.commit(number)
        done.drop("known", number)
        for old in past[:-1]:
            done.drop("state", old)

    writer = turns.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(**trigger) if trigger else writer).start()
