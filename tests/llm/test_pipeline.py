"""The corpus pipeline: each stage against a plain restatement, the whole on given tables, odd rows."""

from collections import defaultdict

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from test_groups import Union, plain_fingerprint

from ragspark.llm import quality, secrets
from ragspark.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, data):
    """Rows after each stage, the given documents first."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(written(stage(spark, out[-1], data), name.replace(" ", "-")))
    return out


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["language ID", "quality classifier", "SimHash near-dedup", "secret scans", "best-fit packing"]
    for frame in stages[1:-1]:
        assert frame.columns == stages[0].columns


def test_clean_documents_stay_and_poor_ones_go(spark, data, stages):
    """Language keeps all that has words; quality keeps what is labelled good and drops most of the rest."""
    given, known, good = by_id(stages[0]), by_id(stages[1]), by_id(stages[2])
    assert len(known) >= 0.97 * len(given)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = lambda q: [i in good for i in known if labels.get(i) == q]
    assert sum(kept(1)) >= 0.97 * len(kept(1)) and sum(kept(0)) <= 0.3 * len(kept(0))
    assert all(good[i].text == given[i].text for i in good)


def test_one_of_each_group_stays(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    union = Union()
    prints = defaultdict(list)
    for i, r in before.items():
        union.find(i)
        prints[plain_fingerprint(r.text)].append(i)
    kinds = sorted(prints)
    for k, a in enumerate(kinds):
        for b in kinds[: k + 1]:
            if (a ^ b).bit_count() <= 4:
                for i in prints[a] + prints[b]:
                    union.join(i, prints[a][0])
    assert set(after) == {union.find(i) for i in before}


def test_secrets_are_masked_and_nothing_goes(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    assert set(before) == set(after)
    for i, r in after.items():
        spans = secrets.find(before[i].text, secrets.KINDS)
        assert r.text == secrets.mask(before[i].text, [(s, e, k) for s, _, k, e in spans])
        assert r.n_chars == len(r.text)


def test_sequences_hold_each_document_once(stages):
    docs, rows = by_id(stages[4]), stages[5].collect()
    texts, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        texts[r.doc_id].append((r.piece, r.text))
        bins[r.bin_id].append(r)
    assert {i: "".join(t for _, t in sorted(p)) for i, p in texts.items()} == {i: r.text for i, r in docs.items()}
    for held in bins.values():
        assert sum(r.length for r in held) <= 8192 and all(len(r.text) == r.length for r in held)
        assert len({docs[r.doc_id].source for r in held}) == len(held)


def test_run_equals_its_stages(spark, data, stages):
    assert {(r.doc_id, r.piece, r.text) for r in cp.run(spark, data).collect()} == {(r.doc_id, r.piece, r.text) for r in stages[5].collect()}


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows_pass_each_stage(spark, data, stage):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some plain words of a text", "en", "s", 3), (3, "some plain words of a text", "en", "s", 3),
            (3, "some plain words of a text", "en", "s", 3), (4, "token=abcdefgh and other words", "en", None, 1), (5, "word " * 30_000, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", fp int").repartition(2)
    name, run = cp.STAGES[stage]
    got = run(spark, docs, data)
    if stage < 4:
        assert got.columns == docs.columns
    kept = got.collect()
    if name == "language ID":
        assert {r.doc_id for r in kept} == set() or all(r.text for r in kept)
    if name == "SimHash near-dedup":
        assert sorted((r.doc_id for r in kept), key=str) == sorted([1, None, 4, 5], key=str)
    if name == "secret scans":
        assert len(kept) == len(rows) and [r.text for r in kept if r.doc_id == 4] == ["[assign] and other words"]
    assert run(spark, docs.filter("false"), data).count() == 0


def test_one_row_of_each_group_whatever_its_id(spark, data):
    """Null and repeated ids on different texts: no group vanishes and none stays twice; ties go to the smaller text."""
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    rows = [(None, a), (None, b), (7, b), (5, c), (5, d), (9, d), (5, d.upper()), (8, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    kept = cp.near_dedup(spark, docs, data).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, a), (None, b), (5, c), (5, d.upper())], key=str)


def test_rows_are_judged_one_by_one(spark, data):
    """A blank or poor row takes no other row of its id along, null or not."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    good = {(r.text, r.source, r.lang) for r in cp.quality_classifier(spark, docs, data).collect()}
    assert 0 < len(good) < docs.count()
    same = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(7)).cast("long"))
    mixed = docs.unionByName(same.withColumn("text", F.when(F.col("doc_id").isNull(), F.lit(" ")).otherwise(F.col("text"))).filter("text = ' '").limit(3))
    shared = mixed.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(1 << 40)).cast("long"))
    model = quality.fit(shared, spark.read.parquet(f"{data}/labels.parquet"))
    numbered = written(shared.withColumn("n", F.monotonically_increasing_id()), "numbered")
    keeps = {r.doc_id for r in quality.classify(numbered, model, doc_id="n").filter("keep").select("doc_id").collect()}
    expected = sorted((str(r.doc_id), r.text) for r in numbered.collect() if r.n in keeps)
    got = sorted((str(r.doc_id), r.text) for r in cp.quality_classifier(spark, shared, data).collect())
    assert got == expected and {i for i, _ in got} == {"None", str(1 << 40)}


def test_pieces_get_their_own_text(spark, data):
    """Repeated and null ids in the packing stage: a piece is there once a row, with the text of that row."""
    rows = [(1, "a" * 9000), (1, "b" * 100), (None, "c" * 50), (None, "d" * 60), (2, "e" * 70), (2, "e" * 70), (3, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted((str(r.doc_id), r.piece, r.length, r.text) for r in cp.best_fit_packing(spark, docs, data).collect())
    expected = [(str(i), k, len((t or "")[8192 * k :][:8192]), (t or "")[8192 * k :][:8192]) for i, t in rows for k in range(1 + (len(t or "") > 8192))]
    assert got == sorted(expected)
