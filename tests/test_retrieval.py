import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.functions import vectors as vec
from ragspark.operators import evaluation as ev
from ragspark.operators import retrieval as rt


def nearest(questions, vectors, k, metric):
    out = {}
    for qid, q in questions.items():
        costs = []
        for vid, v in vectors.items():
            if metric == "l2":
                cost = round(float(((q - v) ** 2).sum()), 9)
            elif metric == "dot":
                cost = round(-float(q @ v), 9)
            else:
                size = np.linalg.norm(q) * np.linalg.norm(v)
                cost = round(1 - (float(q @ v) / size if size else 0.0), 9)
            costs.append((cost, vid))
        out[qid] = [vid for _, vid in sorted(costs)[:k]]
    return out


@pytest.fixture(scope="module")
def grid():
    rng = np.random.default_rng(3)
    vectors = {i: rng.integers(-3, 4, 6).astype(float) for i in range(400)}
    for i in range(150):
        vectors[i] = vectors[0]
    vectors[399] = np.zeros(6)
    questions = {i: rng.integers(-3, 4, 6).astype(float) for i in range(23)}
    return questions, vectors


def frames(spark, grid):
    questions, vectors = grid
    q = spark.createDataFrame([(i, v.tolist()) for i, v in questions.items()], "question_id long, embedding array<double>")
    rows = [(i, v.tolist()) for i, v in vectors.items()] + [(1000, None)]
    return q, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)


@pytest.mark.parametrize("metric", rt.METRICS)
@pytest.mark.parametrize("blocks", [None, 1, 37])
def test_top_k_is_exact(spark, grid, metric, blocks, monkeypatch):
    monkeypatch.setattr(rt, "_SCORES", 500)
    q, v = frames(spark, grid)
    rows = rt.top_k(q.union(q), v, 6, metric=metric, blocks=blocks, carry=True).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.question_id, r["rank"])):
        got.setdefault(r.question_id, []).append(r.vec_id)
        assert r.vector == pytest.approx(grid[1][r.vec_id].tolist())
    assert got == nearest(*grid, 6, metric)


@pytest.mark.parametrize("scale", [1e-5, 1.0, 1e4])
@pytest.mark.parametrize("shift", [0.0, 1.0])
def test_order_holds_at_any_scale(spark, scale, shift):
    rows = [(i, [shift + scale * i, shift]) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(1, [shift + scale * 20, shift]), (2, [shift + scale * 3.2, shift])], "question_id long, embedding array<double>")
    got = rt.top_k(q, v, 3).orderBy("question_id", "rank").collect()
    assert [r.vec_id for r in got] == [20, 19, 21, 3, 4, 2]
    assert [r.score for r in got] == pytest.approx([0, scale, scale, 0.2 * scale, 0.8 * scale, 1.2 * scale], rel=1e-4, abs=1e-18)


def test_many_questions(spark):
    q = spark.range(20_000).select(F.col("id").alias("question_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    v = spark.range(300).select((F.col("id") * 70).alias("vec_id"), F.array((F.col("id") * 70).cast("double"), F.lit(1.0)).alias("embedding"))
    got = rt.top_k(q, v, 2)
    assert got.count() == 40_000
    far = got.filter("rank = 1").filter(F.abs(F.col("question_id") - F.col("vec_id")) > 35)
    assert far.count() == 0


def test_building_reads_nothing(spark):
    bad = spark.range(3).select(F.col("id").alias("vec_id"), F.raise_error(F.lit("read")).cast("array<double>").alias("embedding"))
    rt.top_k(bad.withColumnRenamed("vec_id", "question_id"), bad, 2)


def test_string_ids_and_few_vectors(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "question_id string, embedding array<double>")
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0])], "vec_id string, embedding array<double>")
    rows = rt.top_k(q, v, 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [("a", 0.0), ("b", 0.0)]
    assert rt.top_k(q.limit(0), v, 5).count() == 0
    with pytest.raises(ValueError):
        rt.top_k(q, v, 5, metric="other")


def test_threshold(spark):
    hits = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.9)], "id int, score double")
    assert [r.id for r in rt.above_score(hits, 0.5).collect()] == [2, 3]
    assert [r.id for r in rt.above_score(hits, 0.5, "l2").collect()] == [1, 2]


def test_diverse_top_k(spark):
    q = spark.createDataFrame([(1, [1.0, 1.0])], "question_id long, embedding array<double>")
    v = spark.createDataFrame(
        [(1, [1.0, 0.9]), (2, [1.0, 0.88]), (3, [0.3, 1.0]), (4, [-1.0, -1.0])], "vec_id long, embedding array<double>"
    )
    rows = rt.diverse_top_k(q, v, k=2, fetch_k=3).orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [1, 3]
    rows = rt.diverse_top_k(q, v, k=2, fetch_k=3, balance=1.0).orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [1, 2]


def test_context_and_prompt(spark):
    hits = spark.createDataFrame([(1, 2, "b{question}"), (1, 1, "a")], "question_id long, rank int, text string")
    row = rt.assemble_context(hits).select(
        rt.render(F.lit("{context}|{question}|{{x}}"), {"context": F.col("context"), "question": F.lit("why {context}?")}).alias("p")
    ).first()
    assert row.p == "a\n\nb{question}|why {context}?|{x}"
    with pytest.raises(Exception, match="no value for"):
        hits.select(rt.render(F.lit("{missing}"), {"a": F.lit("b")})).collect()


def test_embedding_of_null(spark):
    assert spark.sql("select cast(null as string) t").select(vec.embed(F.col("t")).alias("e")).first().e is None


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vec.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([2**-0.5, 0.0, 0.0])


def test_evaluate_retrieval(spark):
    def letters(texts):
        return np.array([[t.count(c) for c in "abcd"] for t in texts], dtype=float).reshape(-1, 4)

    texts = {1: "aaab", 2: "bbb", 3: "ccd", 4: "dddd", 5: "ab"}
    store = spark.createDataFrame(list(texts.items()), "vec_id long, text string").select(
        "vec_id", vec.embed(F.col("text"), letters).alias("embedding")
    )
    tests = spark.createDataFrame(
        [(1, "ab", ["a", "ab"]), (2, "dd", ["d"]), (3, "c", [])],
        "question_id long, question string, ideal_context array<string>",
    )
    scores, summary = ev.evaluate_retrieval(store, tests, 2, 0.7, letters)
    rows = {r.question_id: r for r in scores.collect()}
    embed = letters
    for qid, question, ideals in tests.collect():
        near = nearest({0: embed([question])[0]}, {i: embed([t])[0] for i, t in texts.items()}, 2, "l2")[0]
        best = []
        for vid in near:
            v = embed([texts[vid]])[0]
            sims = [float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)) for w in embed(ideals)] if ideals else []
            best.append(max([0.0, *sims]))
        good = sum(b > 0.7 for b in best)
        precision, recall = good / 2, min(good / len(ideals), 1.0) if ideals else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        r = rows[qid]
        assert (r.precision, r.recall, r.retrieved_count) == (precision, recall, 2)
        assert r.f1_score == pytest.approx(f1) and r.avg_relevance == pytest.approx(np.mean(best))
    total = summary.first()
    assert total.total_queries == 3
    assert total.avg_precision == pytest.approx(np.mean([r.precision for r in rows.values()]))


def test_rank_metrics(spark):
    rel = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "question_id long, rank int, is_relevant boolean")
    totals = spark.createDataFrame([(1, 4), (2, 1), (3, 0)], "question_id long, total long")
    got = {(r.question_id, r.k): (r.precision_at_k, r.recall_at_k) for r in ev.at_k(rel, [1, 2, 5], totals).collect()}
    assert got[(1, 2)] == (0.5, 0.25) and got[(1, 5)] == (pytest.approx(2 / 3), 0.5)
    assert got[(3, 5)] == (0.0, 0.0)
    assert ev.mean_reciprocal_rank(rel, totals).first().mrr == pytest.approx((0.5 + 0 + 0) / 3)


def test_judged_answers(spark):
    replies = ['{"relevance": 8, "coherence": 6, "accuracy": 4, "overall_quality": 6}', "", None, "not json", '{"relevance": 2}']
    df = spark.createDataFrame([(r,) for r in replies], "reply string")
    rows = df.select(ev.parse_answer_scores(F.col("reply")).alias("s")).collect()
    assert [r.s.relevance for r in rows] == [8.0, 0.0, 0.0, 0.0, 2.0]
    assert [r.s.accuracy for r in rows] == [4.0, 0.0, 0.0, 0.0, None]
    summary = ev.generation_summary(df.select(ev.parse_answer_scores(F.col("reply")).alias("s")).select("s.*")).first()
    assert summary.avg_relevance == 2.0 and summary.avg_accuracy == 1.0 and summary.total_queries == 5


def test_end_to_end_scores(spark):
    tests = spark.createDataFrame([("a b", "x"), ("c d", None)], "question string, ideal_answer string")
    system = lambda df: df.select(
        "*", F.lit("x").alias("answer"), F.lit("").alias("context"), F.array(F.lit("s")).alias("sources"),
        F.when(F.col("question") == "c d", "boom").alias("error"))
    reply = '{"answer_relevance": 10, "context_relevance": 8, "accuracy": 6, "overall_quality": 4}'
    results, summary = ev.evaluate_rag_system(tests, system, lambda df: F.lit(reply))
    row = summary.first()
    assert (row.avg_answer_relevance, row.total_queries, row.successful_queries) == (5.0, 2, 1)
    answered, total = ev.evaluate_generation(tests, lambda df: df.withColumn("generated_answer", F.lit("x y")))
    assert total.first().total_queries == 2
    prompt = tests.select(ev.answer_prompt(F.col("question"), F.lit("{a}"), F.col("ideal_answer"))).first()[0]
    assert "Question: a b" in prompt and "Answer: {a}" in prompt and '{"relevance": n' in prompt


def test_embedding_holds_little_of_a_large_batch(spark, monkeypatch):
    """What is remembered of words and held of texts has a limit within a batch, and does not change the vectors."""
    texts = [" ".join(f"w{i * 50 + j} a" for j in range(50)) for i in range(60)] + ["", None, "a a"]
    whole = vec.HashedWords()(texts)
    monkeypatch.setattr(vec, "_KEPT", 100)
    monkeypatch.setattr(vec, "_WORDS_HELD", 70)
    small = vec.HashedWords()
    assert np.array_equal(small(texts), whole)
    assert len(small._bucket) <= 100 + 51
    at_once = vec._TEXTS_HELD

    def asked(given):
        return np.asarray([[float(len(given)), float(len(t))] for t in given])

    rows = spark.range(0, 3 * at_once + 5, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("t"))
    got = {r.id: r.v for r in rows.select("id", vec.embed(F.col("t"), asked).alias("v")).collect()}
    assert [i for i, v in got.items() if v is None] == list(range(0, 3 * at_once + 5, 7))
    assert all(v[0] <= at_once and v[1] == i for i, v in got.items() if v is not None)
