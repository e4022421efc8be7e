import random

import pytest
from pyspark.sql import functions as F

from grantrisk.operators import balance as bal
from grantrisk.operators import ranking


@pytest.mark.parametrize("few", [1, 50, 10000])
def test_cuts_are_those_of_the_sorted_rows(spark, monkeypatch, few):
    monkeypatch.setattr(ranking, "FEW", few)
    monkeypatch.setattr(ranking, "DIGITS", 16)
    rng = random.Random(few)
    rows = [(rng.choice(["a", "b", None]), 0.0 if i % 3 == 0 else rng.choice([rng.gauss(0, 1e6), rng.random(), 1e-300, 5e-324, 1.7e308, -1.7e308]), i * 7919 % 1009) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, x double, id long").repartition(5)
    want = {"a": 100, "b": 1, None: 250}
    got = ranking.cuts_of_smallest(df, "x", "id", want, "g")
    for g, k in want.items():
        assert got[g] == sorted((x, i) for h, x, i in rows if h == g)[k - 1]
    kept = df.where("g = 'a'").where(ranking.among_smallest(F.col("x"), F.col("id"), got["a"])).count()
    assert kept == sum((x, i) <= got["a"] for h, x, i in rows if h == "a")
    assert ranking.cuts_of_smallest(df, "x", "id", {"a": 0}, "g") == {} and ranking.cuts_of_smallest(df, "x", "id", {}) == {}


def test_wide_whole_numbers_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FEW", 1)
    keys = [(1 << 60) - i for i in range(300)] + [5, 6]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(keys)], "x long, id long")
    for k in (1, 3, 150, 302):
        assert ranking.cuts_of_smallest(df, "x", "id", {0: k})[0] == sorted(zip(keys, range(302)))[k - 1]


def test_no_window_over_all_rows(spark):
    df = spark.range(5000).selectExpr("id as row_id", "cast(id % 7 = 0 as int) as label")
    out = bal.holdout_split(df)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("split = 'test'").groupBy("label").count().orderBy("label").collect() == sorted(bal.holdout_counts({0: 4285, 1: 715}, 0.1).items())


def test_equal_distances_are_cut_by_id(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FEW", 5)
    rows = [(i, 1, [0.0, 0.0]) for i in range(10)] + [(100 + i, 0, [0.0, 0.0] if i < 60 else [float(i), 1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, label int, embedding array<double>")
    kept = [r.row_id for r in bal.nearmiss(df, 0.25).where("label = 0").collect()]
    assert sorted(kept) == list(range(100, 140))
