"""Session settings used by the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "ragspark", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach, as named by the cluster.

    ``spark.checkpoint.dir`` (or a directory set with ``setCheckpointDir``) is
    used as it is. Only a local master without either gets a fresh folder of
    its own; on a cluster a machine-local folder would lose data with the
    machine, so that case is an error.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        named = current if current else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="ragspark-")
        spark.conf.set(CHECKPOINT_KEY, named)
    return named.rstrip(os.sep)


_made: list[str] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below :func:`shared_dir` that no other run uses; :func:`discard` deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written as Parquet below :func:`shared_dir` and read again, for what is read more than once."""
    path = fresh_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Delete what this driver has written below :func:`shared_dir`; results that still read it must be saved before."""
    gone = 0
    while _made:
        where = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return gone


def ship_package() -> None:
    """Send this package's functions to Python workers by value.

    Workers then need no copy of it on their path. Not needed where the package is
    installed on the cluster or passed with ``--py-files``.
    """
    import ragspark
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(ragspark)
