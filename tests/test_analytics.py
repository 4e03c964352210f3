import random
import statistics

import pytest
from pyspark.sql import functions as F

from ragspark.operators import analytics as an


def test_list_statistics(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 10.0],), ([5.0],)], "v array<double>")
    a, b = [r.s for r in df.select(an.list_statistics(F.col("v")).alias("s")).collect()]
    assert (a.count, a["sum"], a.mean, a.median, a.min, a.max, a.range) == (a.count, 16.0, 4.0, 2.5, 1.0, 10.0, 9.0)
    assert a["count"] == 4 and a.variance == 12.5 and a.std_dev == pytest.approx(12.5**0.5)
    assert a.sorted == [1.0, 2.0, 3.0, 10.0]
    assert b.median == 5.0 and b.variance == 0.0
    with pytest.raises(Exception, match="no statistics"):
        spark.sql("select cast(array() as array<double>) v").select(an.list_statistics(F.col("v"))).collect()


def test_grouped_statistics_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot", rng.lognormvariate(0, 5)) for _ in range(20001)]
    rows += [("far", float(i)) for i in range(3000)] + [("far", 1e18)] + [("tight", 1e9 + i * 1e-3) for i in range(2000)]
    rows += [("same", 4.0)] * 500 + [("two", 1.0), ("two", 2.0), ("null", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in an.number_statistics(df, ["k"], "v").collect()}
    assert set(got) == {"hot", "same", "two", "far", "tight"}
    assert {r.k: r.median for r in an.exact_median(df, ["k"], "v").collect()} == {k: r.median for k, r in got.items()}
    for key, r in got.items():
        values = [v for k, v in rows if k == key]
        assert r["count"] == len(values) and r.median == pytest.approx(statistics.median(values))
        assert r.variance == pytest.approx(statistics.pvariance(values), rel=1e-9 if key != "tight" else 1e-3)
        assert (r.min, r.max) == (min(values), max(values))
    assert [r.v for r in an.sorted_values(df.filter("k = 'two'"), ["k"], "v").collect()] == [1.0, 2.0]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_medians_are_narrowed_until_few_values_are_ranked(spark, monkeypatch, broadcast):
    """Clumps, outliers, many equal values and infinite ones: exact, and no window ranks more than the bound."""
    monkeypatch.setattr(an, "_GAP", 0.2)
    monkeypatch.setattr(an, "_RANKED", 40)
    monkeypatch.setattr(an, "_BINS", 16)
    monkeypatch.setattr(an, "_BROADCAST", broadcast)
    rng = random.Random(3)
    groups = {
        "clump": [1e-9 * rng.random() for _ in range(3000)] + [1e9 * rng.random() for _ in range(2999)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(3001)],
        "even": [float(i) for i in range(4000)],
        "equal": [2.5] * 3000 + [float(i) for i in range(100)],
        "two": [1.0] * 1000 + [7.0] * 1000,
        "infinite": [float("-inf")] * 700 + [float(i) for i in range(900)] + [float("inf")] * 700,
        "few": [3.0, -1.0],
    }
    rows = [(k, v) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    seen = []
    original = an._within
    monkeypatch.setattr(an, "_within", lambda r, e, k, v: seen.append((r, e)) or original(r, e, k, v))
    got = {r.k: r.median for r in an.exact_median(df, ["k"], "v").collect()}
    assert got == {k: statistics.median(v) for k, v in groups.items()}
    assert len(seen) > 2
    last = original(*seen[-1], ["k"], "v").filter("v >= __low AND __low < __high")
    assert max((r["count"] for r in last.select("k", "v").distinct().groupBy("k").count().collect()), default=0) <= 40


@pytest.mark.parametrize(
    "text,value", [("a + b * 2", 8.0), ("(a+b)*2", 10.0), ("-a - -b", 1.0), ("a--b", 5.0), ("a / b", 2 / 3), ("1.5*a", 3.0), (".5+2.", 2.5)]
)
def test_formula(spark, text, value):
    df = spark.createDataFrame([(2, 3)], "a int, b int")
    assert df.select(an.formula(text, df.columns)).first()[0] == pytest.approx(value)


@pytest.mark.parametrize("text", ["", "a b", "a ** 2", "a // 2", "a + ", "(a", "a)", "c", "__import__('os')", "a; b", "007", "()", "* a"])
def test_formula_errors(spark, text):
    with pytest.raises(ValueError):
        an.formula(text, ["a", "b"])


ALL = {
    "enabled": True,
    "calculator": {"enabled": True, "tools": ["multiply", "calculate_expression", "statistics"]},
    "text_analyzer": {"enabled": True, "tools": ["count_words", "analyze_text"]},
}


@pytest.mark.parametrize(
    "config,count",
    [
        ({"enabled": False}, 0),
        (ALL, 5),
        ({"enabled": True, "calculator": {"enabled": True, "tools": ["multiply", "statistics"]}, "text_analyzer": {"enabled": False}}, 2),
        ({"enabled": True, "calculator": {"enabled": False, "tools": ["multiply"]}, "text_analyzer": {"enabled": True, "tools": ["count_words"]}}, 1),
        ({"enabled": True, "other": {"enabled": True, "tools": ["multiply"]}}, 0),
        ({"enabled": True, "calculator": {"enabled": True, "tools": ["multiply", "nothing"]}}, 1),
        ({}, 0),
    ],
)
def test_registry(config, count):
    assert len(an.enabled_analyses(config)) == count
    assert an.analyses_info(config)["total_tools"] == count


def test_registered_analyses_run(spark):
    tools = an.enabled_analyses(ALL)
    df = spark.createDataFrame([("k", 2.0, 3.0, "some words.")], "k string, a double, b double, text string")
    assert tools["multiply"](df, "a", "b").first()["product"] == 6.0
    assert tools["calculate_expression"](df, "a - b").first()["result"] == -1.0
    assert tools["statistics"](df, ["k"], "a").first()["median"] == 2.0
    assert tools["count_words"](df).first()["basic_stats"]["word_count"] == 2
    assert tools["analyze_text"](df).first()["language_detected"] == "english"
