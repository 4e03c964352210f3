"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm import bpe, langid, packing, permindex, quality, repair, secrets, simhash, spotsigs, tokens, trie, urlfilter, warc
from ragspark.llm.common import learns_from, table, written
from ragspark.session import fresh_dir

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return tokens.counted(docs, bpe.public_path(PIECES))


def op2_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = permindex.valid(table(spark, folder, "embeddings"))
    return permindex.search(rows, rows.filter("id % 20 = 0"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    model = quality.fit(docs, table(spark, folder, "labels"))
    return quality.classify(docs, model)


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.digests(docs, bpe.public_path(RANKS))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    net = langid.train(docs)
    held_out = F.coalesce(~learns_from("doc_id"), F.lit(False)).alias("held_out")
    return langid.predict(docs.select("doc_id", held_out, "text"), net)


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.round_trip(table(spark, folder, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    # all documents in two instalments, as they come in time: a text of the first is not scanned again in the second
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    home = fresh_dir(spark, "ledger")
    parts = [secrets.scan_instalment(docs.filter(half == i), home, i, path="doc_id") for i in (0, 1)]
    found = parts[0].unionByName(parts[1])
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"),
        *[of_kind(kind) for kind in secrets.BASE_KINDS],
        F.sha2(secrets.joined_spans(F.col("spans"), secrets.BASE_KINDS), 256).alias("base_sha256"),
        secrets.joined_spans(F.col("spans")).alias("spans"),
    )


def op8_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    rows = spotsigs.compared(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    keyed = written(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = simhash.near_duplicates(keyed, "row").select(F.col("doc_id").alias("row"), "component_id")
    return packing.pack(keyed.join(groups.hint("shuffle_hash"), "row"), cluster="component_id")


def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return urlfilter.judged(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op12_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return repair.all_conversations(turns, *repair.repair(repair.damaged(turns)))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.trie(*trie.rebuilt(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_permutation_index": op2_permutation_index,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_language_id": op5_language_id,
    "op6_warc": op6_warc,
    "op7_secret_scan": op7_secret_scan,
    "op8_spotsigs": op8_spotsigs,
    "op9_simhash": op9_simhash,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_url_filter": op11_url_filter,
    "op12_structure_repair": op12_structure_repair,
    "op13_prefix_trie": op13_prefix_trie,
}
