"""Input that must neither vanish nor change on its way through an operator."""

import math

import pytest
from pyspark.sql import functions as F

from grantrisk import schemas
from grantrisk.functions import scalar as fx
from grantrisk.operators import balance as bal
from grantrisk.operators import learn
from grantrisk.operators import metrics as mx
from grantrisk.operators import prepare as prep
from grantrisk.session import scratch_path
from grantrisk.sources import text as txt
from grantrisk.streaming.append_load import stream_extracts


def test_decimal_comma_text_reads_back_as_the_same_double(spark):
    xs = [1 / 3, 1e-13, 1e27, 1.7976931348623157e308, 5e-324, -0.1, 0.0, 100.0, 1234567.0, 123456789012345.6, -1e7, 2.5e-7, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    rows = df.select("i", fx.double_to_decimal_comma("x").alias("t")).select("i", "t", fx.decimal_comma_to_double("t").alias("y")).orderBy("i").collect()
    assert [r.y for r in rows] == xs
    assert all(r.t is None or ("E" not in r.t and "." not in r.t) for r in rows)
    assert rows[7].t == "100" and rows[8].t == "1234567" and rows[1].t == "0,0000000000001" and rows[2].t == "1" + "0" * 27


def _extract(spark, name, lines, head="NR_CONVENIO;SIT_CONVENIO"):
    folder = scratch_path(spark, name)
    spark.createDataFrame([("\n".join([head, *lines]),)], "value string").coalesce(1).write.option("lineSep", "\n").text(folder)
    return folder


def test_quoted_line_breaks_stay_in_their_record(spark):
    path = _extract(spark, "t_quoted", ['1;"first\nsecond; part"', "2;plain"])
    rows = txt.read_text_table(spark, path).orderBy("NR_CONVENIO").collect()
    assert [tuple(r) for r in rows] == [("1", "first\nsecond; part"), ("2", "plain")]


def test_a_missing_column_is_an_error(spark):
    df = spark.createDataFrame([("1",)], "a string")
    types = {"a": schemas.spec("convenio").type_of("NR_CONVENIO"), "b": schemas.spec("convenio").type_of("NR_CONVENIO")}
    with pytest.raises(ValueError, match="b"):
        txt.cast_columns(df, types)
    assert txt.cast_columns(df, types, allow_missing=True).first().b is None


def test_a_file_with_swapped_columns_is_not_loaded_by_position(spark):
    src = scratch_path(spark, "t_swapped")
    for head, line in (("NR_CONVENIO;SIT_CONVENIO", f"1;{schemas.STATUS_POSITIVE[0]}"), ("SIT_CONVENIO;NR_CONVENIO", f"{schemas.STATUS_POSITIVE[0]};2")):
        spark.createDataFrame([(f"{head}\n{line}",)], "value string").coalesce(1).write.mode("append").text(src)
    dst, ck = scratch_path(spark, "t_swapped_out"), scratch_path(spark, "t_swapped_ck")
    with pytest.raises(Exception):
        stream_extracts(spark, src, "convenio", dst, ck, filter_status=False, pattern="*.txt", allow_missing=True)


def test_null_labels_and_groups_are_kept(spark):
    rows = [(i, None if i % 5 == 0 else i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id long, label int")
    assert bal.stratified_folds(df, k=4).count() == 50
    split = bal.holdout_split(df)
    assert split.count() == 50 and split.filter("split = 'test'").count() == 5
    p = spark.createDataFrame([("a", 1, 0.9, 1), ("a", 0, 0.2, 0), (None, 1, 0.3, 0), (None, 0, 0.6, 1)],
                              "classifier string, label int, probability double, prediction int")
    assert {r.classifier: r.roc_auc for r in mx.roc_auc(p, group="classifier").collect()} == {"a": 1.0, None: 0.0}
    assert mx.metric_long(p).filter("classifier is null and metric = 'AUC'").first().value == 0.0


def test_draws_for_different_seeds_are_independent(spark):
    df = spark.range(20000).select(fx.uniform01("id", 1).alias("a"), fx.uniform01("id", 2).alias("b"))
    r = df.agg(F.corr("a", "b").alias("c"), F.avg("a").alias("m"), F.countDistinct(F.round(F.col("b") - F.col("a"), 9)).alias("d")).first()
    assert abs(r.c) < 0.03 and abs(r.m - 0.5) < 0.02 and r.d > 15000


def test_parameters_reach_the_estimators(spark):
    assert learn.mlp({"learning_rate_init": 0.02}).getSolver() == "gd" and learn.mlp({"learning_rate_init": 0.02}).getStepSize() == 0.02
    assert learn.mlp().getSolver() == "l-bfgs"
    assert learn.gbt(max_bins=512).getMaxBins() == 512
    with pytest.raises(ValueError):
        learn.gbt({"max_depth": 31})
    from grantrisk.plans import train
    df = spark.createDataFrame([(1, 1, 1.0), (2, 0, 1.0)], "row_id long, label int, weight double")
    assert {r.label: r.weight for r in train.reweighted(df, {"scale_pos_weight": 7}).collect()} == {1: 7.0, 0: 1.0}


def test_an_undefined_fold_makes_the_score_undefined(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 2, i % 2) for i in range(4)], "row_id long, label int, fold int")
    monkeypatch.setattr(learn, "predict", lambda *a: None)
    scores = iter([0.9, None])
    monkeypatch.setattr(learn, "score", lambda *a: next(scores))

    class Any:
        def fit(self, _):
            return None

    assert math.isnan(learn.cv_score(lambda tr: Any(), df, k=2, parallelism=1))


def test_sparse_one_hot_has_no_limit_on_categories(spark):
    n = prep.MAX_WIDE_CATEGORIES + 500
    df = spark.createDataFrame([(i, f"v{i}", None if i % 2 else "even") for i in range(n)], "rid long, a string, b string")
    codes = prep.first_seen_codes(df, ["a", "b"], "rid")
    with pytest.raises(ValueError, match="onehot_sparse"):
        prep.onehot_wide(df, ["a"])
    rows = {r.rid: list(r.onehot) for r in prep.onehot_sparse(df, codes, ["a", "b"]).collect()}
    assert rows[0] == [0, n] and rows[1] == [1] and rows[n - 1] == [n - 1] and len(rows) == n


def test_sparse_vectors_are_written_without_widening(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(1.0, Vectors.sparse(10 ** 8, {3: 2.0, 99999999: 1.0})), (0.0, Vectors.dense([0.0, 4.0]))], ["label", "features"])
    rows = prep.vector_entries(df).orderBy("label").collect()
    assert [[tuple(e) for e in r.entries] for r in rows] == [[(1, 4.0)], [(3, 2.0), (99999999, 1.0)]]


def test_bad_texts_are_listed_and_counted(spark):
    from pyspark.sql import types as T

    from grantrisk.sources import text
    df = spark.createDataFrame([("1", "1.234,5", "3"), ("2", "n/d", " "), ("3", None, "3,5"), ("4", "x", "y")], "k string, a string, b string")
    cast = text.cast_columns(df, {"k": T.StringType(), "a": T.DoubleType(), "b": T.IntegerType()}, rejects="rejects")
    assert sorted(tuple(r) for r in text.reject_table(cast, ["k"]).collect()) == [
        ("2", "a", "n/d"), ("3", "b", "3,5"), ("4", "a", "x"), ("4", "b", "y")]
    assert text.count_rejects(cast, ["a", "b"]).collect() == [(4, 2, 2)]
    assert [r.a for r in cast.orderBy("k").collect()] == [1234.5, None, None, None]
    assert text.cast_columns(df, {"k": T.StringType()}, rejects="r").where("size(r) > 0").count() == 0
