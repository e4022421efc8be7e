import pytest
from pyspark.sql import functions as F

from grantrisk.operators import balance as bal
from grantrisk.operators import prepare as prep


def test_scaling_rules(spark):
    df = spark.createDataFrame([(1.0, 5.0, -4.0), (3.0, 5.0, 2.0)], "a double, c double, m double")
    st = prep.fit_numeric(df, ["a", "c", "m"])
    s = prep.standardize(df, st).collect()
    assert [r["a"] for r in s] == [-1.0, 1.0] and [r["c"] for r in s] == [0.0, 0.0]
    assert [r["m"] for r in prep.maxabs_scale(df, st).collect()] == [-1.0, 0.5]
    nulls = spark.createDataFrame([(1.0,), (None,), (3.0,)], "a double")
    assert [r[0] for r in prep.impute_mean(nulls, prep.fit_numeric(nulls, ["a"])).collect()] == [1.0, 2.0, 3.0]


def test_first_seen_codes_and_onehot(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "a")], "rid long, c string")
    codes = {r["value"]: r["code"] for r in prep.first_seen_codes(df, ["c"], "rid").collect()}
    assert codes == {"b": 0, "a": 1, "missing": 2}
    wide = prep.onehot_wide(df, ["c"]).orderBy("rid").collect()
    assert [(r["c_a"], r["c_b"]) for r in wide] == [(0, 1), (1, 0), (0, 0), (1, 0)]


def _matrix(spark, n_maj=100, n_min=5):
    rows = [(i, 0, [float(i % 10), float(i % 7)]) for i in range(n_maj)]
    rows += [(1000 + i, 1, [20.0 + i, 20.0 - i]) for i in range(n_min)]
    return spark.createDataFrame(rows, "row_id long, label int, embedding array<float>")


def test_smote_counts_and_segments(spark):
    out = bal.smote(_matrix(spark), 0.1)
    new = out.filter("synthetic").collect()
    assert len(new) == 5
    pts = {r["row_id"]: r["embedding"] for r in out.filter(~F.col("synthetic")).collect()}
    for r in new:
        x, nb, u = pts[r["base_id"]], pts[r["neighbour_id"]], r["step"]
        assert r["label"] == 1 and 0.0 <= u < 1.0
        assert r["embedding"] == pytest.approx([a + u * (b - a) for a, b in zip(x, nb)])


def test_nearmiss_counts_and_subset(spark):
    m = _matrix(spark)
    out = bal.nearmiss(m, 0.1)
    assert out.filter("label = 0").count() == 50 and out.filter("label = 1").count() == 5
    assert out.join(m.select("row_id"), "row_id", "left_anti").count() == 0
    with pytest.raises(ValueError):
        bal.nearmiss(m, 0.01)
    with pytest.raises(ValueError):
        bal.smote(m, 0.01)


def test_knn_engines_and_chunks_agree(spark):
    m = _matrix(spark, 60, 30)
    m = m.unionByName(m.filter("label = 1").withColumn("row_id", F.col("row_id") + 500))  # exact ties
    mino, majo = m.filter("label = 1"), m.filter("label = 0")

    def ids(df):
        return {r["row_id"]: [(e["d2"], e["id"]) for e in r["nn"]] for r in df.collect()}
    ref = ids(bal.knn(majo, mino, 3, engine="sql"))
    assert ids(bal.knn(majo, mino, 3)) == ref
    assert ids(bal.knn(majo, mino, 3, max_bytes=200)) == ref
    assert ids(bal.knn(majo, mino, 3, max_bytes=200, engine="sql")) == ref
    self_sql = ids(bal.knn(mino, mino, 4, exclude_self=True, engine="sql"))
    assert ids(bal.knn(mino, mino, 4, exclude_self=True)) == self_sql
    assert ids(bal.knn(mino, mino, 4, exclude_self=True, max_bytes=200)) == self_sql
    assert ids(bal.knn(mino, mino, 4, exclude_self=True, max_bytes=200, engine="sql")) == self_sql


def test_folds_and_holdout(spark):
    rows = [(i, 0) for i in range(95)] + [(100 + i, 1) for i in range(25)]
    df = spark.createDataFrame(rows, "row_id long, label int")
    f = bal.stratified_folds(df, k=10)
    assert f.count() == 120
    per = {(r["fold"], r["label"]): r["n"] for r in f.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    assert all(per[(k, 0)] in (9, 10) for k in range(10)) and all(per[(k, 1)] in (2, 3) for k in range(10))
    h = bal.holdout_split(df, test_share=0.1)
    t = {r["label"]: r["n"] for r in h.filter("split = 'test'").groupBy("label").agg(F.count("*").alias("n")).collect()}
    # n_test = 12, n_train = 108: 85.5 / 22.5 -> the tied remainder goes to the smaller label
    assert t == {0: 9, 1: 3}
    assert bal.holdout_counts({0: 95, 1: 25}, 0.1) == {0: 9, 1: 3}
    assert bal.holdout_counts({0: 348, 1: 51}, 0.1) == {0: 35, 1: 5}


def test_balanced_weights(spark):
    df = spark.createDataFrame([(i, 0) for i in range(6)] + [(9, 1), (10, 1)], "row_id long, label int")
    w = {r["label"]: r["weight"] for r in bal.class_weights(df).collect()}
    assert w == {0: 8 / 12, 1: 8 / 4}


def test_unknown_category_is_an_error(spark):
    from pyspark.errors import PySparkException
    from py4j.protocol import Py4JJavaError
    df = spark.createDataFrame([(1, "b", 1.0), (2, "a", 2.0)], "rid long, c string, x double")
    model, _ = prep.linear_pipeline(df, ["x"], ["c"], "rid")
    assert model.transform(df).count() == 2
    new = spark.createDataFrame([(3, "zzz", 1.0)], "rid long, c string, x double")
    with pytest.raises((PySparkException, Py4JJavaError)):
        model.transform(new).collect()


def test_linear_prep_save_load(spark):
    from grantrisk.session import scratch_path
    df = spark.createDataFrame([(1, "b", 1.0), (2, "a", None), (3, "a", 4.0)], "rid long, c string, x double")
    model, _ = prep.linear_pipeline(df, ["x"], ["c"], "rid")
    path = scratch_path(spark, "t_prep")
    model.save(path)
    back = prep.LinearPrep.load(path)
    a = [r["features"].toArray().tolist() for r in model.transform(df).orderBy("rid").collect()]
    b = [r["features"].toArray().tolist() for r in back.transform(df).orderBy("rid").collect()]
    assert a == b


def test_empty_inputs(spark):
    from grantrisk.operators import metrics as mx
    empty = spark.createDataFrame([], "row_id long, label int, embedding array<float>")
    m = _matrix(spark, 5, 2)
    assert bal.knn(m, empty, 3).filter(F.size("nn") == 0).count() == 7
    assert bal.holdout_counts({}, 0.1) == {}
    assert bal.holdout_split(spark.createDataFrame([], "row_id long, label int")).count() == 0
    p = spark.createDataFrame([], "label int, probability double, prediction int")
    assert [r["roc_auc"] for r in mx.roc_auc(p).collect()] == [None]  # undefined area, as SQL aggregates


def test_knn_with_many_cells_and_one_oversized(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    spots = rng.normal(scale=20, size=(30, 6))
    refs = [(i, (spots[i % 30] + rng.normal(size=6)).tolist()) for i in range(200)] + [(1000 + i, spots[0].tolist()) for i in range(150)]
    queries = [(5000 + i, (spots[i % 30] + rng.normal(size=6)).tolist()) for i in range(90)]
    r, q = (spark.createDataFrame(x, "row_id long, embedding array<double>") for x in (refs, queries))
    lists = lambda df: {x.row_id: [(e.d2, e.id) for e in x.nn] for x in df.collect()}
    assert lists(bal.knn(q, r, 4, max_bytes=2000)) == lists(bal.knn(q, r, 4, engine="sql"))
    assert lists(bal.knn(r, r, 3, exclude_self=True, max_bytes=2000)) == lists(bal.knn(r, r, 3, exclude_self=True, engine="sql"))


def test_knn_names_the_row_of_an_odd_vector(spark):
    good = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "row_id long, embedding array<double>")
    for odd in ([1.0], [1.0, None], None):
        bad = spark.createDataFrame([(7, odd)], "row_id long, embedding array<double>")
        with pytest.raises(Exception, match="7|components"):
            bal.knn(bad, good, 1).collect()


def test_a_wide_matrix_says_its_width_but_names_no_component(spark):
    from grantrisk.operators import learn
    df = spark.createDataFrame([(i, f"c{i % 300}", float(i), None if i == 2 else 1.0 + i % 2) for i in range(600)], "rid long, c string, x double, z double")
    model, _ = prep.linear_pipeline(df, ["x", "z"], ["c"], "rid")
    out = model.transform(df, ["rid"])
    assert out.columns == ["rid", "features"] and learn.vector_width(out) == 302
    assert len(out.schema.json()) < 2000  # was a description of every component, parsed by the driver
    st, rows = model.imputed_stats, {r["rid"]: r["features"] for r in out.collect()}
    for i in (0, 2, 301):
        z = st.mean["z"] if i == 2 else 1.0 + i % 2
        want = {0: (i - st.mean["x"]) / st.std_pop["x"], 1: (z - st.mean["z"]) / st.std_pop["z"], 2 + i % 300: 1.0}
        got = dict(zip(rows[i].indices.tolist(), rows[i].values.tolist()))
        assert rows[i].size == 302 and got == pytest.approx({k: v for k, v in want.items() if v})


def test_narrow_vectors_are_dense_where_that_is_smaller(spark):
    from pyspark.ml.linalg import DenseVector
    df = spark.createDataFrame([(1, "b", 1.0), (2, "a", 2.0), (3, None, 4.0)], "rid long, c string, x double")
    model, _ = prep.linear_pipeline(df, ["x"], ["c"], "rid")
    rows = {r["rid"]: r["features"] for r in model.transform(df).collect()}
    assert all(isinstance(v, DenseVector) for v in rows.values())
    assert {i: v.toArray()[1:].tolist() for i, v in rows.items()} == {1: [1.0, 0.0, 0.0], 2: [0.0, 1.0, 0.0], 3: [0.0, 0.0, 1.0]}
