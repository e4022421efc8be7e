"""M3: perceptron with one hidden layer on sparse rows.

The network, loss and stopping rule are those of Spark's
``MultilayerPerceptronClassifier``: sigmoid units, two softmax outputs, mean
cross-entropy, L-BFGS (or gradient descent at ``learning_rate_init``) from
seeded uniform weights.  Spark's writes every row out to the whole width of
the matrix and keeps them all; here rows stay sparse (:mod:`packed`) and a
task returns the gradient of the columns that its rows have.  The driver holds
the weights and the last steps, never data.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Generator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantrisk import schemas
from grantrisk.operators import packed
from grantrisk.operators.learn import MLP_DEFAULTS
from grantrisk.operators.neighbours import rows_of, sparse_columns

# Functions that run in Python workers are pickled by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Steps and gradients that the driver remembers, fewer if they would take more bytes; values that a stop looks back on; products at once.
MEMORY, MEMORY_BYTES, LOOK_BACK, BLOCK = 10, 1 << 28, 20, 1 << 22


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _activate(z: np.ndarray) -> np.ndarray:
    """Sigmoid of ``z`` in its place: an exponential takes half the time of a tanh."""
    with np.errstate(over="ignore"):
        np.negative(z, out=z)
        np.exp(z, out=z)
    z += 1
    return np.divide(1.0, z, out=z)


@dataclass
class PerceptronModel:
    """Weights: inputs x units, units' biases, units x 2, outputs' biases."""
    hidden: np.ndarray
    hidden_bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray
    passes: int = 0
    loss: float = math.nan
    features: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` without its vectors, with ``probability`` (vector of two) and ``prediction``."""
        keep = [f for f in df.schema.fields if not isinstance(f.dataType, VectorUDT)]
        held = df.sparkSession.sparkContext.broadcast((self.hidden, self.hidden_bias, self.output, self.output_bias))  # arrays only, see many.held_out
        n = len(keep)
        rows = df.select(*[F.col(f"`{f.name}`") for f in keep], F.lit(0).cast("long").alias("__id"), *sparse_columns(self.features))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)

        def run(batches):
            w1, b1, w2, b2 = held.value
            for batch in batches:
                out, all_rows = [np.empty(0)], rows_of(batch, "__id")
                step = max(1, BLOCK // (w1.shape[1] * max(1, math.ceil(len(all_rows.index) / max(1, batch.num_rows)))))
                for lo in range(0, batch.num_rows, step):
                    r = all_rows.take(slice(lo, min(lo + step, batch.num_rows)))
                    known = r.index < len(w1)  # columns that no training row has say nothing
                    row = np.repeat(np.arange(len(r.ids)), np.diff(r.starts))[known]
                    z = np.tile(b1, (len(r.ids), 1))
                    if len(row):
                        first = np.flatnonzero(np.diff(row, prepend=-1))
                        z[row[first]] += np.add.reduceat(r.value[known, None] * w1[r.index[known]], first, axis=0)
                    o = _sigmoid(z) @ w2 + b2
                    out.append(_sigmoid(o[:, 1] - o[:, 0]))
                p = np.concatenate(out)
                both = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * 2, pa.int32()), pa.array(np.stack([1 - p, p], axis=1).ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), both, pa.array((p > 0.5).astype(np.float64))],
                                                 names=[*(f.name for f in keep), "probability", "prediction"])

        scored = rows.mapInArrow(run, f"{schema}{', ' if n else ''}probability array<double>, prediction double")
        return scored.withColumn("probability", array_to_vector("probability"))


def _split(x: np.ndarray, width: int, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a = width * units
    return x[:a].reshape(width, units), x[a:a + units], x[a + units:a + 3 * units].reshape(units, 2), x[a + 3 * units:]


def loss_and_gradient(data: packed.Packed, x: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of all rows and its gradient, in one pass."""
    def work(held, block):
        w1, b1, w2, b2 = held
        a = block.products(w1)  # in place from here: a block's activations are the bulk of the work
        a += b1
        _activate(a)
        o = a @ w2 + b2
        o -= o.max(axis=1, keepdims=True)
        total = np.exp(o).sum(axis=1, keepdims=True)
        d = np.exp(o) / total
        y = block.label.astype(np.int64)
        loss = float((np.log(total[:, 0]) - o[np.arange(len(y)), y]).sum())
        d[np.arange(len(y)), y] -= 1
        out, back = a.T @ d, d @ w2.T
        back *= a
        np.subtract(1, a, out=a)
        back *= a
        return back, np.concatenate([back.sum(axis=0), out.ravel(), d.sum(axis=0), [loss]])

    n = max(1, sum(data.rows.values()))
    w1, other = packed.summed(data, _split(x, data.width, units), units, 3 * units + 3, work)
    return float(other[-1]) / n, np.concatenate([w1.ravel(), other[:-1]]) / n


Steps = Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, float]]


def lbfgs(x: np.ndarray, max_iter: int, tol: float) -> Steps:
    """Yields points, is sent the loss and gradient there, returns the last point and its loss.

    Ends when the best of the last LOOK_BACK values improves on the worst by
    at most ``tol`` of the first, or the gradient's norm is at most ``tol``
    of the value.
    """
    value, g = yield x
    memory = max(3, min(MEMORY, MEMORY_BYTES // (16 * len(x))))
    start, values, pairs = abs(value), [value], []
    for _ in range(max_iter):
        if float(np.linalg.norm(g)) <= max(tol * abs(value), 1e-8):
            break
        d, alphas = g.copy(), []
        for s, y, sy in reversed(pairs):
            alphas.append(float(s @ d) / sy)
            d -= alphas[-1] * y
        if pairs:
            d *= pairs[-1][2] / float(pairs[-1][1] @ pairs[-1][1])
        for (s, y, sy), alpha in zip(pairs, reversed(alphas)):
            d += (alpha - float(y @ d) / sy) * s
        slope = -float(d @ g)
        if slope >= 0:
            d, pairs, slope = g.copy(), [], -float(g @ g)
        length = 1.0 if pairs else 1.0 / max(1e-300, float(np.linalg.norm(d)))
        while True:
            new = x - length * d
            new_value, new_g = yield new
            if new_value <= value + 1e-4 * length * slope or length < 1e-10:
                break
            length *= 0.5
        if not new_value <= value:
            break
        s, y = new - x, new_g - g
        sy = float(s @ y)
        if sy > 1e-12 * float(y @ y):
            pairs = [*pairs[max(0, len(pairs) + 1 - memory):], (s, y, sy)]
        x, value, g = new, new_value, new_g
        values = [*values[1 - LOOK_BACK:], value]
        if max(values) - value <= tol * start:
            break
    return x, value


def descent(x: np.ndarray, rate: float, max_iter: int, tol: float) -> Steps:
    """Gradient descent at ``rate`` over the root of the step's number, until a step is at most ``tol`` of the point."""
    value = math.nan
    for i in range(1, max_iter + 1):
        value, g = yield x
        step = rate / math.sqrt(i) * g
        x = x - step
        if float(np.linalg.norm(step)) < tol * max(float(np.linalg.norm(x)), 1.0):
            break
    return x, value


@dataclass
class Perceptron:
    """``fit`` as an estimator's; parameters as in ``learn.mlp``."""
    params: dict | None = None
    n_features: int = 1
    features: str = "features"
    label: str = "label"
    seed: int = schemas.SEED

    def fit(self, df: DataFrame) -> PerceptronModel:
        p = {**MLP_DEFAULTS, **(self.params or {})}
        units, rate = int(p["hidden_layer_sizes"]), p.get("learning_rate_init")
        data = packed.pack(df, None, self.label, None, self.features)
        data = data._replace(width=max(data.width, self.n_features))
        rng = np.random.default_rng(self.seed)
        size = [(data.width + 1) * units, 2 * units + 2]
        reach = [2.4 / math.sqrt(data.width), 2.4 / math.sqrt(units)]  # as Spark's
        x = np.concatenate([rng.uniform(-r, r, n) for r, n in zip(reach, size)])
        steps = lbfgs(x, int(p["max_iter"]), float(p["tol"])) if rate is None else descent(x, float(rate), int(p["max_iter"]), float(p["tol"]))
        passes = 0
        try:
            point = next(steps)
            while True:
                passes += 1
                point = steps.send(loss_and_gradient(data, point, units))
        except StopIteration as end:
            x, loss = end.value
        return PerceptronModel(*_split(x, data.width, units), passes, loss, self.features)
