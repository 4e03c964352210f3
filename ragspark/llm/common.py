"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.session import fresh_dir

#: Texts handed to Python code at a time; keeps the copies that Python makes of a batch small.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written as Parquet below the cluster's shared folder and read again.

    Cuts lineage, so that a lost executor costs a read and not the whole computation.
    """
    path = fresh_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice stay near :data:`SLICE_BYTES` (one text at least)."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    frame: DataFrame, text: str, fresh: Callable[[], Callable[[list], dict[str, pa.Array]]], fields: str
) -> DataFrame:
    """Replace the column ``text`` by computed columns; all other columns pass through.

    ``fresh()`` runs once in each task and returns a function from a list of texts
    (``None`` for null) to Arrow arrays by name. ``fields`` is their DDL. A computed
    column takes the place of a column of its name.
    """
    from pyspark.sql import types as T

    made = T.StructType.fromDDL(fields)
    kept = [f for f in frame.schema.fields if f.name != text and f.name not in made.names]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fresh()
        for batch in batches:
            for part in text_slices(batch, text):
                got = work(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names] + [got[n] for n in made.names], names + made.names
                )

    return frame.select(*names, text).mapInArrow(run, T.StructType(kept + made.fields))


def learns_from(doc_id: str) -> F.Column:
    """Rows that a model may learn from: crc32 of the id as text, modulo 3, is not 1."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) != 1


def kept_in_worker(name: str, make: Callable[[], object]) -> object:
    """A value made once in a Python worker and found again by its later tasks.

    Code shipped by value has fresh globals in each task, so the value lives in a module of its own.
    """
    import sys
    import types

    home = sys.modules.setdefault("_corpus_tables", types.ModuleType("_corpus_tables"))
    values = home.__dict__.setdefault("values", {})
    if name not in values:
        values[name] = make()
    return values[name]
