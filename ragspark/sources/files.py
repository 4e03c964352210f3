"""Readers and writers for documents, test sets, vectors, results and the query log."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragspark import schemas

log = logging.getLogger(__name__)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_documents(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Whole files as ``text, source``. A missing file is skipped with a warning.

    Names may be globs. No file at all is a ``FileNotFoundError``.
    """
    paths = []
    for name in names:
        path = f"{folder.rstrip('/')}/{name}"
        if _exists(spark, path):
            paths.append(path)
        else:
            log.warning("File not found: %s", path)
    if not paths:
        raise FileNotFoundError("No documents were loaded")
    return (
        spark.read.text(paths, wholetext=True)
        .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"))
    )


def with_doc_id(df: DataFrame, source: str = "source") -> DataFrame:
    """Add a ``doc_id`` of 128 bits that stays the same when the job is repeated."""
    return df.withColumn("doc_id", F.md5(source))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of a JSON array; missing fields are empty. Adds a stable ``question_id``.

    A case that is given again is a case of its own, with an id of its own.
    """
    rows = spark.read.schema(schemas.GOLDEN).json(path, multiLine=True)
    whole = rows.select(
        "question",
        F.coalesce("ideal_answer", F.lit("")).alias("ideal_answer"),
        F.coalesce("ideal_context", F.expr("cast(array() as array<string>)")).alias("ideal_context"),
    )
    times = Window.partitionBy("question", "ideal_answer").orderBy("ideal_context")
    return whole.withColumn("question_id", F.xxhash64("question", "ideal_answer", F.row_number().over(times))).select(
        "question_id", "question", "ideal_answer", "ideal_context"
    )


def write_vectors(df: DataFrame, path: str) -> None:
    """Overwrite a vector table with ``chunk_id, embedding, text, source``."""
    df.select(*schemas.VECTORS.fieldNames()).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        raise FileNotFoundError(f"No vector table at {path}; build it with plans.ingestion.ingest")
    return spark.read.schema(schemas.VECTORS).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """JSON lines, non-ASCII text kept."""
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str, strict: bool = False) -> bool:
    """Append log rows. Unless ``strict``, a failure is reported and not raised."""
    try:
        df.write.mode("append").parquet(path)
        return True
    except (AnalysisException, PySparkException) as problem:
        if strict:
            raise
        log.warning("Query log not written: %s", problem)
        return False
