import math

from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from grantrisk.operators import balance as bal
from grantrisk.operators import learn


def _separable(spark, n=240):
    rows = []
    for i in range(n):
        x = (i * 37 % 101) / 50.0 - 1.0
        y = ((i * 53) % 89) / 44.0 - 1.0
        rows.append((i, int(x + 0.3 * y > 0), Vectors.dense([x, y, (i % 7) / 7.0])))
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("label", T.IntegerType()),
                           T.StructField("features", VectorUDT())])
    df = spark.createDataFrame(rows, schema)
    return bal.class_weights(bal.holdout_split(df, test_share=0.25), mode="balanced")


def test_models_learn_a_separable_fixture(spark):
    df = _separable(spark)
    tr, te = df.filter("split = 'train'"), df.filter("split = 'test'")
    ests = {"gbt": learn.gbt({"n_estimators": 20, "max_depth": 3}),
            "logit": learn.logit(None, n_rows=tr.count()),
            "mlp": learn.mlp({"hidden_layer_sizes": 5, "max_iter": 200}, n_features=3)}
    for name, est in ests.items():
        pred = learn.predict(est.fit(tr), te)
        auc = learn.score(pred, "roc_auc")
        assert auc is not None and math.isfinite(auc) and auc > 0.9, (name, auc)
        vals = [r["value"] for r in learn.metric_rows(pred, name).collect()]
        assert all(v is None or math.isfinite(v) for v in vals)


def test_same_seed_same_model(spark):
    df = _separable(spark)
    tr = df.filter("split = 'train'")
    p = {"n_estimators": 10, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 0.7}
    a = [r["probability"] for r in learn.predict(learn.gbt(p).fit(tr), df).orderBy("row_id").collect()]
    b = [r["probability"] for r in learn.predict(learn.gbt(p).fit(tr), df).orderBy("row_id").collect()]
    assert a == b
