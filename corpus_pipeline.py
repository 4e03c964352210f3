"""A training corpus from raw documents: five stages, each written and read by the next.

``STAGES`` are (name, function) pairs; a function takes ``(spark, docs, sf_dir)`` and returns the rows it keeps.
All but the last return the columns of ``docs``; the last returns the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm import langid, packing, quality, secrets, simhash
from ragspark.llm.common import table, written
from ragspark.session import ship_package

ship_package()

#: A text whose best language is less likely than this is rejected, as is one without letters.
MIN_LANGUAGE_SCORE = 0.4
#: No SQL has a trained network, 64-bit shingle hashes or best-fit search; tested against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised."""
    net = langid.train(docs)
    judged = langid.predict(docs, net, keep_text=True)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return judged.filter(known).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose own evidence and site speak for them; each row is judged by itself, whatever its id."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    # what a decision depends on; null and empty are judged alike
    parts = [F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256) for c in ("text", "source", "lang")]
    keyed = docs.withColumn("__key", F.sha2(F.concat(*parts), 256))
    judged = quality.classify(keyed, model, doc_id="__key")
    going = judged.filter(~F.col("keep")).select(F.col("doc_id").alias("__key")).distinct().hint("shuffle_hash")
    return keyed.join(going, "__key", "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of linked fingerprints (four-word shingles, four bits at most): that of the smallest id, then the smallest text; a null id is the smallest."""
    keyed = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    linked = simhash.near_duplicates(keyed, "__row")
    groups = linked.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group"))
    # a group by its ids; texts are read only where rows share the smallest id
    rows = written(keyed.select("__row", F.struct("doc_id").alias("__id")).join(groups, "__row"), "grouped")
    ids = rows.groupBy("__group", "__id").agg(F.min("__row").alias("__row"), F.count(F.lit(1)).alias("__n"))
    first = written(ids.groupBy("__group").agg(F.min(F.struct("__id", "__row", "__n")).alias("f")).select("__group", "f.*"), "first")
    tied = rows.join(first.filter("__n > 1").select("__group", "__id"), ["__group", "__id"]).select("__row", "__group").hint("shuffle_hash")
    by_text = keyed.select("__row", "text").join(tied, "__row").groupBy("__group").agg(F.min(F.struct("text", "__row"))["__row"].alias("__row"))
    kept = first.filter("__n = 1").select("__row").union(by_text.select("__row")).hint("shuffle_hash")
    return keyed.join(kept, "__row", "left_semi").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets; no document goes."""
    found, _ = secrets.scan(docs, path="doc_id")
    clean = secrets.redacted(docs, found, "doc_id")
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most the capacity: a row per piece with its text, ordered by ``position`` in ``bin_id``."""
    keyed = docs.withColumn("__text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    packed = written(packing.pack(keyed, carry="__text"), "packed").withColumnRenamed("__text", "__packed")
    texts = keyed.select(F.col("doc_id").alias("__id"), "__text", "text").dropDuplicates(["__id", "__text"])
    joined = packed.join(texts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__packed") == F.col("__text")))
    piece = F.coalesce(F.col("text"), F.lit("")).substr((F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    return joined.select("bin_id", "position", "doc_id", "piece", "start", "length", piece.alias("text"))


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
