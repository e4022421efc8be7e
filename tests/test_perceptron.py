import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors

from grantrisk.operators import learn, packed, perceptron
from grantrisk.plans import train


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(300):
        v = {0: float(rng.normal()), 1: float(rng.normal()), 2 + int(rng.integers(150)): 1.0}
        data.append((i, int(v[0] * v[1] > 0), Vectors.sparse(152, v) if i % 7 else Vectors.dense([v.get(j, 0.0) for j in range(152)])))
    data.append((300, 1, Vectors.sparse(152, {})))
    return spark.createDataFrame(data, ["row_id", "label", "features"]).repartition(3).cache()


def test_loss_and_gradient_are_those_of_the_rows_written_out(rows):
    data = packed.pack(rows, None, "label", None, "features")
    x = np.random.default_rng(2).normal(size=(152 + 1) * 4 + 10)
    local = rows.collect()
    dense, y = np.array([r.features.toArray() for r in local]), np.array([r.label for r in local])

    def loss(p):
        w1, b1, w2, b2 = perceptron._split(p, 152, 4)
        o = 1 / (1 + np.exp(-(dense @ w1 + b1))) @ w2 + b2
        return float(np.mean(np.logaddexp(o[:, 0], o[:, 1]) - o[np.arange(len(y)), y]))

    value, gradient = perceptron.loss_and_gradient(data, x, 4)
    assert np.isclose(value, loss(x)) and len(gradient) == len(x)
    for i in [0, 5, 300, 607, 608, 612, 615, 620, 621]:
        step = np.eye(len(x))[i] * 1e-6
        assert np.isclose(gradient[i], (loss(x + step) - loss(x - step)) / 2e-6, atol=1e-6)


def test_a_fit_is_as_good_as_that_of_spark(rows):
    model = perceptron.Perceptron({"hidden_layer_sizes": 6, "max_iter": 300}, 152).fit(rows)
    spark_fit = MultilayerPerceptronClassifier(layers=[152, 6, 2], maxIter=300, tol=1e-4, seed=1).fit(rows)
    assert model.loss < spark_fit.summary().objectiveHistory[-1] + 0.05
    pred = learn.predict(model, rows).collect()
    assert len(pred) == 301 and all(r.prediction == int(r.probability > 0.5) for r in pred)
    assert sum(r.prediction == r.label for r in pred) > 270


def test_a_wide_matrix_is_never_written_out(spark):
    # 300 rows of 2,000,000 columns would be 4.8 GB as Spark's stacked dense rows
    wide = spark.range(300).select("id").rdd.map(lambda r: (r.id, r.id % 2, Vectors.sparse(2_000_000, {0: float(r.id % 2), 5_000 * (r.id + 1): 1.0}))) \
        .toDF(["row_id", "label", "features"])
    data = packed.pack(wide, None, "label", None, "features")
    assert data.width == 1_500_001 and data.rows == {0: 300}
    value, gradient = perceptron.loss_and_gradient(data, np.zeros((data.width + 1) * 1 + 4), 1)
    assert np.isclose(value, np.log(2)) and len(gradient) == data.width + 5


def test_training_uses_the_sparse_perceptron(rows):
    assert isinstance(train.make_estimator("mlp", None, rows), perceptron.Perceptron)
    slow = train.make_estimator("mlp", {"learning_rate_init": 0.5, "hidden_layer_sizes": 3, "max_iter": 3}, rows).fit(rows)
    assert slow.passes == 3
