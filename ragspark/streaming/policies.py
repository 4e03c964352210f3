"""Rate limit, time-bounded reuse and checks on streams.

A micro-batch is decided as a batch is: its calls are counted by time, merged by a sort with the admitted calls that are still within
reach, and streamed in time order. So a trigger may hold any number of calls of a key, and what is held is the
admitted calls within reach. The admitted calls that later batches may need are written beside the decisions and committed with
them, by batch number: a batch that is run again after a failure starts from the same past, and changes nothing if it was committed.
"""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ragspark.operators.admission import MICROS, _assigned, admitted_after, epoch_micros
from ragspark.streaming.batches import BatchLog

log = logging.getLogger(__name__)

_KEY = "__key"


def _decide(
    stream: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    max_calls: int,
    reach: int,
    name: str,
    path: str,
    checkpoint: str,
    delay_seconds: float,
    trigger: dict,
) -> StreamingQuery:
    """Write each micro-batch with the decision ``name`` to a :class:`BatchLog`.

    An admitted time is kept until it is ``reach`` and the delay behind the latest time seen, as a late call may still need it. A late call is
    judged by the admitted calls before it; what was decided after it stands. Rows without a time get ``false``; null keys are a key.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = BatchLog(spark, path)
        past = done.committed()
        if number in past:
            return
        key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
        rows = batch.withColumn("__t", epoch_micros(batch, ts)).withColumn(_KEY, key)
        known = rows.filter("__t IS NOT NULL")
        counts = known.groupBy(_KEY, "__t").agg(F.count(F.lit(1)).alias("__n"))
        clock = None
        if past:
            clock = done.note(past[-1]).get("clock")
            history = spark.read.schema(f"{_KEY} string, __t long, __n long").parquet(done.folder("history", past[-1]))
        else:
            history = counts.select(_KEY, "__t", "__n").filter("false")
        taken_at = done.folder("taken", number)
        admitted_after(counts, history, [_KEY], max_calls, reach).write.mode("overwrite").parquet(taken_at)
        taken = spark.read.schema(f"{_KEY} string, __t long, __taken long").parquet(taken_at)
        told = _assigned(rows, known, [_KEY], taken.filter("__taken > 0"), tie, max_calls)
        out = told.withColumn(name, F.coalesce(F.col(tie) <= F.col("__last"), F.lit(False))).select(*batch.columns, name)
        out.write.mode("overwrite").parquet(done.folder("data", number))
        latest = taken.agg(F.max("__t")).first()[0]
        clock = max((t for t in (clock, latest) if t is not None), default=None)
        kept = history.union(taken.filter("__taken > 0")).groupBy(_KEY, "__t").agg(F.sum("__n").alias("__n"))
        if clock is not None:
            kept = kept.filter(F.col("__t") > clock - round(delay_seconds * MICROS) - reach)
        kept.write.mode("overwrite").parquet(done.folder("history", number))
        done.commit(number, {"clock": clock})
        done.drop("taken", number)
        for old in past[:-1]:
            done.drop("history", old)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(**trigger) if trigger else writer).start()


def rate_limit_stream(
    stream: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    path: str,
    checkpoint: str,
    max_calls: int = 10,
    window_seconds: float = 60,
    delay_seconds: float = 3600,
    **trigger: object,
) -> StreamingQuery:
    """Write a stream of calls with ``allowed`` to ``path``; see :func:`read_log`."""
    reach = round(window_seconds * MICROS) + 1
    return _decide(stream, keys, ts, tie, max_calls, reach, "allowed", path, checkpoint, delay_seconds, trigger)


def ttl_reuse_stream(
    stream: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    path: str,
    checkpoint: str,
    ttl_seconds: float = 300,
    delay_seconds: float = 3600,
    **trigger: object,
) -> StreamingQuery:
    """Write a stream of calls with ``is_computed`` to ``path``: false where an earlier call of the key is still valid."""
    return _decide(stream, keys, ts, tie, 1, round(ttl_seconds * MICROS), "is_computed", path, checkpoint, delay_seconds, trigger)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that were committed at ``path``."""
    return BatchLog(spark, path).read()


def log_stream(
    stream: DataFrame, path: str, checkpoint: str, strict: bool = True, **trigger: object
) -> StreamingQuery:
    """Append a stream of log rows to a parquet table of its own.

    The file sink's own log makes that exactly once, also after a failure. With ``strict=False`` the table is a :class:`BatchLog`
    (read it with :func:`read_log`), and the stream goes on where a batch cannot be written there: the batch is reported and waits beside the
    checkpoint, and is written before the next one that succeeds. Nothing is lost or written twice; only a
    batch that can be written to neither place ends the stream, which then resumes with it.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    if strict:
        return writer.format("parquet").option("path", path).outputMode("append").start()

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done, aside = BatchLog(spark, path), BatchLog(spark, f"{checkpoint}/aside")
        try:
            flush_waiting(done, aside)
            done.put(batch, number)
        except (PySparkException, Py4JJavaError) as problem:
            log.warning("Batch %s is not in the log yet and waits: %s", number, problem)
            if number not in aside.waiting():
                batch.write.mode("overwrite").parquet(aside.folder("held", number))
                aside.spark.range(0).write.mode("overwrite").parquet(aside.folder("waiting", number))

    return writer.foreachBatch(write).start()


def flush_waiting(done: BatchLog, aside: BatchLog) -> int:
    """Write the batches that wait, oldest first; how many were written."""
    written = 0
    for number in aside.waiting():
        written += done.put(aside.spark.read.parquet(aside.folder("held", number)), number)
        aside.drop("waiting", number)
        aside.drop("held", number)
    return written
