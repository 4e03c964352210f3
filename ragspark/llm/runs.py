"""Numbering rows inside keys of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm.common import written

_PART, _LEAD, _ROW = "__part", "__lead", "__row"


def numbered(frame: DataFrame, key: str, order: list[Column], name: str = "pos", carry: list[str] | None = None) -> DataFrame:
    """``key``, the columns of ``carry`` (all others unless given) and ``name``: 0, 1, ... in the order of ``order`` within ``key``.

    Rows are sorted by ranges of key and order, so a key may lie in any number of tasks; equal rows are told apart by
    a row number of the input, so they may too. A task numbers the keys it sees; only its first may
    have begun in an earlier task, so one number a task (the rows of that key before it) puts all right. Those numbers, a
    row a task, are what the driver sees. The result is a written table; ``key`` must not be null.
    """
    others = [c for c in frame.columns if c != key] if carry is None else carry
    placed = [F.col(key).asc(), *order, F.col(_ROW).asc()]
    ranged = frame.withColumn(_ROW, F.monotonically_increasing_id())
    ordered = ranged.repartitionByRange(*placed).sortWithinPartitions(*placed).select(key, *others, F.spark_partition_id().alias(_PART))
    schema = T.StructType(
        [*ordered.schema.fields, T.StructField(_LEAD, T.BooleanType()), T.StructField(name, T.LongType()), T.StructField("__last", T.BooleanType())]
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, lead, held = None, 0, True, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(0)
            if n > 1:
                changes = np.flatnonzero(pa.compute.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
            else:
                changes = np.zeros(0, dtype=np.int64)
            starts = np.r_[0, changes]
            sizes = np.diff(np.r_[starts, n])
            before = np.zeros(len(starts), dtype=np.int64)
            if last is not None and keys[0].as_py() == last:
                before[0] = count
            elif last is not None:
                lead = False
            pos = np.arange(n) - np.repeat(starts - before, sizes)
            leads = np.zeros(n, dtype=bool)
            if lead:
                leads[: sizes[0]] = True
                lead = len(starts) == 1
            last, count = keys[n - 1].as_py(), int(pos[-1]) + 1
            if held is not None:
                yield held
            ends = np.zeros(n, dtype=bool)
            columns = [*batch.columns, pa.array(leads), pa.array(pos), pa.array(ends)]
            held = pa.RecordBatch.from_arrays(columns, names=schema.names)
        if held is not None:
            ends = np.zeros(held.num_rows, dtype=bool)
            ends[-1] = True
            yield held.set_column(len(schema.names) - 1, "__last", pa.array(ends))

    local = written(ordered.mapInArrow(number, schema), "numbered")
    spark = frame.sparkSession
    ends = {r[_PART]: r for r in local.filter("__last").select(_PART, key, _LEAD, name).collect()}
    offsets, before, at = [], 0, None
    for part in sorted(ends):
        r = ends[part]
        if at is not None:
            offsets.append((part, at, before))
        rows = r[name] + 1
        before = before + rows if r[_LEAD] and r[key] == at else rows
        at = r[key]
    kind = T.StructType([T.StructField(_PART, T.IntegerType()), T.StructField("__from", frame.schema[key].dataType), T.StructField("__before", T.LongType())])
    carried = F.broadcast(spark.createDataFrame(offsets, kind))
    add = F.when(F.col(_LEAD) & (F.col("__from") == F.col(key)), F.col("__before")).otherwise(0)
    return local.join(carried, _PART, "left").select(key, *others, (F.col(name) + F.coalesce(add, F.lit(0))).alias(name))
