"""Documents to chunks to vectors."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions.vectors import Embedder, embed
from ragspark.operators.chunking import recursive_chunks, semantic_chunks
from ragspark.sources import files


def chunk_documents(
    documents: DataFrame,
    chunk_size: int = 1000,
    chunk_overlap: int = 200,
    use_semantic_chunking: bool = True,
    breakpoint_threshold_type: str = "percentile",
    embedder: Embedder | None = None,
) -> DataFrame:
    """Chunks with the columns of their document and ``chunk_no``."""
    if use_semantic_chunking:
        return semantic_chunks(
            documents, threshold_type=breakpoint_threshold_type, embedder=embedder
        )
    return recursive_chunks(documents, chunk_size=chunk_size, chunk_overlap=chunk_overlap)


def vector_rows(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """``chunk_id, embedding, text, source``; the id is document and chunk number."""
    return chunks.select(
        F.concat_ws("-", "doc_id", "chunk_no").alias("chunk_id"),
        embed(F.col("text"), embedder).alias("embedding"),
        "text",
        "source",
    )


def ingestion_summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: number of documents, chunks and sources."""
    rows = documents.select(F.lit(1).alias("d"), F.lit(0).alias("c"), "source").unionByName(
        chunks.select(
            F.lit(0).alias("d"), F.lit(1).alias("c"), F.lit(None).cast("string").alias("source")
        )
    )
    return rows.agg(
        F.sum("d").alias("num_documents"),
        F.sum("c").alias("num_chunks"),
        F.count_distinct("source").alias("num_sources"),
    )


def ingest(
    spark: SparkSession,
    folder: str,
    names: list[str],
    index_path: str,
    embedder: Embedder | None = None,
    **chunking: Any,
) -> dict[str, Any]:
    """Read, chunk, embed and write; returns the counts of what was written."""
    started = time.time()
    documents = files.with_doc_id(files.read_documents(spark, folder, names))
    chunks = chunk_documents(documents, embedder=embedder, **chunking)
    files.write_vectors(vector_rows(chunks, embedder), index_path)
    written = files.read_vectors(spark, index_path).agg(
        F.count("*").alias("chunks"), F.count_distinct("source").alias("sources")
    ).first()
    return {
        "num_documents": documents.count(),
        "num_chunks": written["chunks"],
        "index_path": index_path,
        "files_used": names,
        "pipeline_time": time.time() - started,
        "parameters": chunking,
    }
