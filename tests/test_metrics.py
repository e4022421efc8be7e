import random

import pytest
from pyspark.sql import functions as F

from grantrisk.operators import metrics as mx
from grantrisk.operators import ranking


def _preds(spark, labels, scores):
    rows = [(i, y, float(s), int(s >= 0.5)) for i, (y, s) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(rows, "row_id long, label int, probability double, prediction int")


def test_scores_from_counts(spark):
    rows = [(0, 0)] * 50 + [(0, 1)] * 10 + [(1, 0)] * 5 + [(1, 1)] * 35
    df = spark.createDataFrame(rows, "label int, prediction int")
    r = mx.hard_scores(df).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (50, 10, 5, 35)
    assert r["accuracy"] == pytest.approx(0.85)
    assert r["precision"] == pytest.approx(0.777778, abs=1e-6)
    assert r["recall"] == pytest.approx(0.875)
    assert r["specificity"] == pytest.approx(0.833333, abs=1e-6)
    assert r["f_measure"] == pytest.approx(0.823529, abs=1e-6)
    none = mx.hard_scores(spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")).first()
    assert none["precision"] is None and none["f_measure"] is None


def test_auc_and_ap_small(spark):
    p = _preds(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    assert mx.roc_auc(p).first()["roc_auc"] == pytest.approx(0.75)
    assert mx.average_precision(p).first()["avg_precision"] == pytest.approx(0.833333, abs=1e-6)
    t = _preds(spark, [0, 1], [0.5, 0.5])
    assert mx.roc_auc(t).first()["roc_auc"] == pytest.approx(0.5)
    assert mx.average_precision(t).first()["avg_precision"] == pytest.approx(0.5)


def test_auc_equals_pair_count(spark):
    rng = random.Random(7)
    labels = [rng.randint(0, 1) for _ in range(300)]
    scores = [round(rng.random(), 2) for _ in range(300)]  # many ties
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    brute = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    got = mx.roc_auc(_preds(spark, labels, scores)).first()["roc_auc"]
    assert got == pytest.approx(brute)


def test_curves_have_end_points(spark):
    p = _preds(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    roc = sorted((r["fpr"], r["tpr"]) for r in mx.roc_points(p).collect())
    assert roc[0] == (0.0, 0.0) and roc[-1] == (1.0, 1.0)
    pr = mx.pr_points(p).collect()
    assert any(r["threshold"] is None and r["precision"] == 1.0 and r["recall"] == 0.0 for r in pr)


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(0, float(x)) for x in [0, 1, 2, 3, 4, 10]], "label int, x double")
    h = mx.class_histogram(df, "x", "label", 5).orderBy("bin").collect()
    assert [r["n"] for r in h] == [2, 2, 1, 0, 1]
    c = mx.cumulative_histogram(mx.class_histogram(df, "x", "label", 5), "label").orderBy("bin").collect()
    assert c[0]["cumulative"] == pytest.approx(1.0) and c[-1]["cumulative"] == pytest.approx(1 / 6)


def test_bucketed_running_sum_equals_single_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 2000).select("id", (F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    b = ranking.quantile_bucket(df, "k", 16)
    got = ranking.row_number_global(b, [F.col("k"), F.col("id")], "__bucket", ["g"], out="rn")
    ref = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    j = got.join(ref, on=["id"])
    assert j.filter(F.col("rn") != F.col("rn2")).count() == 0


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.integers(0, 2), st.integers(0, 9)),
                min_size=1, max_size=60),
       st.integers(1, 6), st.booleans())
def test_running_sums_property(spark, rows, n_buckets, descending):
    from pyspark.sql import Window
    data = [(i, k, g, v) for i, (k, g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k int, g int, v int")
    b = ranking.quantile_bucket(df, "k", n_buckets, descending=descending)
    key = F.col("k").desc_nulls_last() if descending else F.col("k").asc_nulls_first()
    got = ranking.running_sums(b, [key, F.col("id")], {"s": F.col("v")}, "__bucket", ["g"])
    w = Window.partitionBy("g").orderBy(key, "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = {r["id"]: r["s"] for r in df.withColumn("s", F.sum("v").over(w)).collect()}
    assert {r["id"]: r["s"] for r in got.collect()} == ref


def test_histogram_keeps_rows_of_a_null_class_and_group(spark):
    df = spark.createDataFrame([(1.0, None, None), (2.0, None, None), (2.0, 1, "a"), (None, 1, "a"), (5.0, 1, None)], "x double, y int, g string")
    rows = mx.class_histogram(df, "x", "y", 2, ["g"]).collect()
    assert sorted(((r.g, r.y, r.bin, r.n) for r in rows), key=repr) == sorted(
        [(None, None, 0, 1), (None, None, 1, 1), ("a", 1, 0, 1), ("a", 1, 1, 0), (None, 1, 0, 1), (None, 1, 1, 0)], key=repr)
