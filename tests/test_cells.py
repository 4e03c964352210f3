"""Retrieval by cells: exact with any centroids, approximate to its recall, bounded slices, skipped visits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.operators import cells, retrieval


def frame(spark, rows, name, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in r]) for i, r in enumerate(rows)], f"{name} long, embedding array<float>")


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(25, 16)) * 4
    rows = centres[rng.integers(0, 25, 3000)] + rng.normal(size=(3000, 16))
    rows[100:700] = rows[100]
    rows[5] = 0
    asked = rows[::60] + rng.normal(size=(50, 16)) * 0.05
    return frame(spark, rows, "vec_id").repartition(3), frame(spark, asked, "question_id"), rows, asked


def hits(found):
    return sorted((r.question_id, r.rank, r.vec_id, round(r.score, 6)) for r in found.collect())


@pytest.mark.parametrize("metric", retrieval.METRICS)
def test_exact_search_skips_cells_and_equals_top_k(spark, clustered, metric):
    vectors, asked, _, _ = clustered
    index = cells.build_index(vectors, metric=metric, slice_bytes=16 * 8 * 200)
    found, visits = cells.search(index, asked, 10)
    assert hits(found) == hits(retrieval.top_k(asked, vectors, 10, metric=metric))
    share = cells.visit_share(index, visits, 50)
    assert 0 < share < (0.9 if metric == "dot" else 0.5)
    # 600 equal vectors make one cell, which is cut; no slice holds much more than its bytes
    assert index.cells.parts.max() >= 3
    assert index.rows.groupBy("__cell", "__part").count().agg(F.max("count")).first()[0] < 2 * 200


@pytest.mark.parametrize("metric", retrieval.METRICS)
def test_approximate_search_reaches_its_recall(spark, metric):
    """Vectors without any structure, the worst case: 0.9 of the true neighbours, for fewer visits than the exact search."""
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(4000, 32))
    vectors, asked = frame(spark, rows, "vec_id").repartition(4), frame(spark, rng.normal(size=(200, 32)), "question_id")
    index = cells.build_index(vectors, metric=metric)
    found, visits = cells.search(index, asked, 10, recall=0.95)
    truth = {(r.question_id, r.vec_id) for r in retrieval.top_k(asked, vectors, 10, metric=metric).collect()}
    got = {(r.question_id, r.vec_id) for r in found.collect()}
    assert len(got & truth) / len(truth) >= 0.9
    assert cells.visit_share(index, visits, 200) < 0.9


def test_bounds_hold_for_every_vector(spark, clustered):
    vectors, _, rows, asked = clustered
    for metric in retrieval.METRICS:
        index = cells.build_index(vectors, metric=metric, cells=9)
        lowest = index.cells.bounds(asked)
        cell = {r["__id"]: r["__cell"] for r in index.rows.select("__id", "__cell").collect()}
        place = np.array([cell[i] for i in range(len(rows))])
        for q in range(0, 50, 7):
            cost = retrieval._exact(np.repeat(asked[q : q + 1], len(rows), axis=0), rows.astype(np.float32).astype(float), metric)
            assert (lowest[q][place] <= cost + 1e-6).all()


def test_few_vectors_odd_rows_and_string_ids(spark):
    vectors = spark.createDataFrame([("b", [0.0, 1.0]), ("a", [0.0, 1.0]), ("c", None), ("d", [5.0, 5.0])], "vec_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [0.0, 1.0]), ("q", [9.0, 9.0]), ("n", None)], "question_id string, embedding array<float>")
    index = cells.build_index(vectors)
    for recall in (None, 0.9):
        found, _ = cells.search(index, asked, 5, recall=recall)
        assert [(r.question_id, r["rank"], r.vec_id) for r in found.orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, "d")]
    empty = cells.build_index(vectors.filter("false"))
    assert cells.search(empty, asked, 3)[0].count() == 0
    assert cells.search(index, asked.filter("false"), 3, recall=0.9)[0].count() == 0
    with pytest.raises(ValueError):
        cells.search(index, asked, 0)
    with pytest.raises(ValueError):
        cells.build_index(vectors, metric="l1")


def test_blocks_of_the_exact_search_follow_the_estimate(spark, clustered, monkeypatch):
    vectors = clustered[0]
    assert retrieval._blocks(vectors, 4) == 4
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 10_000)
    path = spark.createDataFrame([(1, [1.0] * 64)], "vec_id long, embedding array<double>")
    assert retrieval._blocks(path, 4) >= 4
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert retrieval._blocks(given, 4) > 4


def test_recall_on_the_given_vectors(spark):
    """The registered query against the exact one, over all given questions."""
    from ragspark.plans import queries

    folder = "/root/testdata/sf0.1"
    truth = {(r.question_id, r.vec_id) for r in queries.topk_by_cells(spark, folder).collect()}
    got = {(r.question_id, r.vec_id) for r in queries.topk_approximate(spark, folder).collect()}
    assert len(truth) == 1000 and len(got & truth) >= 0.9 * len(truth)
