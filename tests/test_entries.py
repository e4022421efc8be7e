import math

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from grantrisk.operators import prepare as prep
from grantrisk.plans import queries as Q


def test_values_are_seen_as_round_sees_them(spark):
    at = 5e-7
    xs = [0.0, -0.0, at, -at, math.nextafter(at, 0), math.nextafter(at, 1), math.nextafter(-at, 0), 4.9999999e-7, 5e-324, 1e300, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    want = [r.i for r in df.where(F.round("x", 6) != 0).orderBy("i").collect()]
    seen = df.where(Q._seen("x"))
    assert [r.i for r in seen.orderBy("i").collect()] == want and len(want) == 7
    assert "round" not in seen._jdf.queryExecution().optimizedPlan().toString()


def test_entries_round_no_value(spark):
    rows = [("7", 1, Vectors.sparse(4, [(1, 2.0), (3, 4e-7)])), ("8", 0, Vectors.dense([0.0, -3.0, 6e-7, 1.0])), ("9", 0, Vectors.sparse(4, []))]
    out = Q._entries(spark.createDataFrame(rows, ["NR_CONVENIO", "TARGET", "features"]))
    assert sorted((r.NR_CONVENIO, r.label, r.idx, r.value) for r in out.collect()) == [("7", 1, 1, 2.0), ("8", 0, 1, -3.0), ("8", 0, 2, 6e-7), ("8", 0, 3, 1.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "round" not in plan and "zip_with" not in plan


def test_a_missing_vector_has_no_entries(spark):
    df = spark.createDataFrame([(1, Vectors.dense([2.0, 0.0])), (2, Vectors.sparse(2, [1], [0.5]))], ["i", "features"])
    df = df.withColumn("features", F.when(F.col("i") == 2, F.col("features")))
    got = {r.i: r.entries for r in prep.vector_entries(df).collect()}
    assert got[1] is None and got[2] == [(1, 0.5)]
