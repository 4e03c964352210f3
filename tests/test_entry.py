import duckdb
import pytest

import __spark_entry__ as driver
from ragspark.plans import queries as registered

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUICK = [
    "language_mix", "top_words", "injection_check", "toxicity_any", "pii_spans", "fixed_chunks",
    "semantic_chunks_percentile", "topk_cosine", "document_retrieval", "number_stats", "rate_limit",
    "session_filter", "guardrail_report", "checks_on_stream", "vector_table", "pii_counts", "pii_masked_all", "pii_verdict",
    "recursive_chunks", "rendered_templates", "call_fingerprint_named", "rate_limit_on_stream", "ttl_reuse", "mmr",
    "text_files", "results_file", "topk_by_cells", "lexicon_matches",
    "golden_cases", "quick_generation", "template_files", "custom_patterns", "custom_check", "gated_checks", "custom_embedder", "chosen_analyses",
]
RUN_WHEN_BUILT = ("checks_on_stream", "vector_table", "rate_limit_on_stream", "ttl_reuse_on_stream", "text_files", "results_file", "topk_by_cells", "topk_approximate",
                  "answer_pairs_on_stream", "session_filter_on_stream", "golden_cases", "quick_generation", "template_files", "lexicon_matches")


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as from '{data}/{name}.parquet'")
    return con


def plain(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, data, name):
    frame = driver.queries()[name](spark, data)
    sql = duck.sql(driver.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(sql.columns)
    assert rows(frame.columns, frame.collect()) == rows(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", [n for n in registered.QUERIES if n not in RUN_WHEN_BUILT])
def test_no_query_plans_a_cross_join(spark, data, name):
    plan = driver.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan, "row-at-a-time Python"
