import json

import pytest
from pyspark.sql import functions as F

from ragspark.operators.chunking import recursive_chunks
from ragspark.plans import ingestion, quick
from ragspark.sources import files, templates


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.txt").write_text("First file. It has text.\n\nSecond part.", encoding="utf-8")
    (tmp_path / "b.txt").write_text("สวัสดี " * 30, encoding="utf-8")
    return tmp_path


def test_documents(spark, folder):
    df = files.read_documents(spark, str(folder), ["a.txt", "missing.txt", "b.txt"])
    rows = {r.source.rsplit("/", 1)[1]: r.text for r in df.collect()}
    assert set(rows) == {"a.txt", "b.txt"} and rows["a.txt"].endswith("Second part.")
    with pytest.raises(FileNotFoundError):
        files.read_documents(spark, str(folder), ["missing.txt"])


def test_ingest(spark, folder, tmp_path):
    index = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        files.read_vectors(spark, index)
    out = ingestion.ingest(spark, str(folder), ["*.txt"], index, use_semantic_chunking=False, chunk_size=40, chunk_overlap=5)
    table = files.read_vectors(spark, index)
    assert out["num_documents"] == 2 and out["num_chunks"] == table.count() > 4
    assert table.filter(F.size("embedding") != 64).count() == 0
    again = ingestion.ingest(spark, str(folder), ["a.txt"], index)
    assert again["num_chunks"] == files.read_vectors(spark, index).count() < out["num_chunks"]
    docs = files.with_doc_id(files.read_documents(spark, str(folder), ["*.txt"]))
    row = ingestion.ingestion_summary(docs, recursive_chunks(docs)).first()
    assert (row.num_documents, row.num_sources) == (2, 2)


def test_golden(spark, tmp_path):
    path = tmp_path / "golden.json"
    path.write_text(json.dumps([{"question": "คำถาม", "ideal_answer": "a", "ideal_context": ["c"]}, {"question": "q"}, {"question": "q"}], ensure_ascii=False))
    rows = files.read_golden(spark, str(path)).orderBy(F.desc("ideal_answer")).collect()
    assert rows[0].question == "คำถาม" and rows[0].ideal_context == ["c"]
    assert rows[1].ideal_answer == "" and rows[1].ideal_context == []
    assert len({r.question_id for r in rows}) == 3


def test_results_and_log(spark, tmp_path):
    df = spark.createDataFrame([("ü", 1)], "a string, n int")
    files.write_results(df, str(tmp_path / "deep" / "out"))
    assert spark.read.json(str(tmp_path / "deep" / "out")).first().a == "ü"
    log = str(tmp_path / "log")
    assert files.append_log(df, log) and files.append_log(df, log)
    assert spark.read.parquet(log).count() == 2
    bad = df.withColumn("n", F.raise_error(F.lit("boom")))
    assert files.append_log(bad, log) is False
    with pytest.raises(Exception, match="boom"):
        files.append_log(bad, log, strict=True)


def test_templates(spark, tmp_path):
    block = "template: |\n  Line {context}\n    indented\n\n  Ask {question}\n"
    (tmp_path / "sales_support_v2.yaml").write_text(block, encoding="utf-8")
    (tmp_path / "sales_support_v10.yaml").write_text('template: "ten {question}"\n', encoding="utf-8")
    (tmp_path / "plain.yaml").write_text("template: just {question}\n", encoding="utf-8")
    values = {"strip": "template: |-\n  a\n  b\n", "fold": "template: >\n  a\n  b\n\n  c\n", "quoted": 'template: "a\\n\\t{x}" # note\n', "single": "template: 'it''s'\n"}
    for name, text in values.items():
        (tmp_path / f"{name}.yaml").write_text(text, encoding="utf-8")
    (tmp_path / "broken_v1.yaml").write_text("other: x\n", encoding="utf-8")
    df = templates.read_templates(spark, str(tmp_path))
    import yaml

    assert templates.pick_template(df, "sales_support", "v2") == yaml.safe_load(block)["template"]
    assert templates.pick_template(df, "sales_support") == "ten {question}"
    assert templates.pick_template(df, "plain") == "just {question}"
    for name, text in values.items():
        assert templates.pick_template(df, name) == yaml.safe_load(text)["template"]
    rows = spark.createDataFrame([(1, "sales_support", None), (2, "sales_support", "v2"), (3, "none", None), (4, None, None)], "id int, template_name string, template_version string")
    joined = {r.id: r.template for r in templates.with_templates(rows, df).collect()}
    assert joined == {1: "ten {question}", 2: yaml.safe_load(block)["template"], 3: None, 4: None}
    df = df.filter(~F.col("name").isin(list(values)))
    listed = {r.name: r.versions for r in templates.list_templates(df).collect()}
    assert listed == {"sales_support": ["v10", "v2"], "plain": ["default"], "broken": ["v1"]}
    with pytest.raises(KeyError):
        templates.pick_template(df, "broken")
    with pytest.raises(FileNotFoundError):
        templates.pick_template(df, "sales_support", "v3")


def test_quick_evaluations(spark, folder, tmp_path):
    index = str(tmp_path / "index")
    ingestion.ingest(spark, str(folder), ["a.txt"], index, use_semantic_chunking=False, chunk_size=20, chunk_overlap=0)
    path = tmp_path / "golden.json"
    cases = [{"question": "first file", "ideal_answer": "first file", "ideal_context": ["First file."]}, {"question": "second part"}]
    path.write_text(json.dumps(cases))
    scores, summary = quick.quick_retrieval_eval(files.read_vectors(spark, index), str(path), k=2)
    assert scores.count() == 2 and summary.first().total_queries == 2 and summary.first().avg_recall == 0.5
    answer = lambda df: df.withColumn("generated_answer", F.col("question"))
    _, summary = quick.quick_generation_eval(spark, answer, str(path))
    assert summary.first().avg_overall_quality == 5.0
    system = lambda df: df.select(
        "*", F.col("question").alias("answer"), F.col("question").alias("context"),
        F.expr("cast(array() as array<string>)").alias("sources"), F.lit(None).cast("string").alias("error"))
    _, summary = quick.quick_rag_eval(spark, system, str(path))
    row = summary.first()
    assert (row.avg_answer_relevance, row.avg_accuracy, row.successful_queries) == (10.0, 5.0, 2)


def test_scratch_tables_are_deleted(spark):
    from ragspark.session import discard, fresh_dir

    path = fresh_dir(spark, "scratch")
    spark.range(3).write.parquet(path)
    assert files._exists(spark, path) and discard(spark) >= 1
    assert not files._exists(spark, path) and discard(spark) == 0
