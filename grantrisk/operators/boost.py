"""Second-order boosted trees (M1) with a learned direction for missing values.

Log-loss gradients g and hessians h are summed per (node, feature, bin) in
one grouped aggregation per level; the best split of each node is chosen from
running sums over its bins, for missing values going left or right:

    gain = (GL^2 / (HL + l) + GR^2 / (HR + l) - G^2 / (H + l)) / 2 - gamma

with ``min_child_weight`` a least hessian per child.  Rows never move: a
row's node follows from its bins and the splits so far (a few numbers per
node), walked batch by batch, so a level costs one pass, in which each task
adds up its rows, and a shuffle of at most nodes x features x bins partial
sums per task.  The driver holds the trees.
"""

from __future__ import annotations

import math
import pickle
import random
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grantrisk import schemas
from grantrisk.functions.scalar import uniform01
from grantrisk.session import cut_lineage

# Functions that run in Python workers are pickled by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEFAULTS = {"n_estimators": 150, "max_depth": 6, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0,
            "gamma": 0.0, "min_child_weight": 1.0, "reg_lambda": 1.0}
#: Trees between two rewrites of the margins, decimals to which gains are compared, most levels of a tree.
CUT_EVERY, DIGITS, MAX_DEPTH = 5, 9, 16
#: Cells (node, feature, bin) up to which a task adds up a level in one array, 24 bytes each.
MAX_CELLS = 1 << 20


@dataclass
class Tree:
    """Arrays over node numbers (root 1, children 2n and 2n + 1): split feature (-1: leaf), cut, direction of missing values, value."""
    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray


@dataclass
class Model:
    """Trees and the columns that they read; the margin is ``bias`` plus one leaf value a tree."""
    columns: list[str]
    cuts: list[list[float]]
    bias: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """(tree, node, column, cut, missing_left, value, gain): a row per node; leaves have a NULL column."""
        rows = [(t, n, self.columns[x.feature[n]] if x.feature[n] >= 0 else None, float(x.cut[n]) if x.feature[n] >= 0 else None,
                 bool(x.missing_left[n]) if x.feature[n] >= 0 else None, float(x.value[n]), float(x.gain[n]))
                for t, x in enumerate(self.trees) for n in range(1, len(x.feature)) if n == 1 or x.feature[n // 2] >= 0]
        return spark.createDataFrame(rows, "tree int, node int, column string, cut double, missing_left boolean, value double, gain double")

    def importances(self, spark: SparkSession) -> DataFrame:
        """(column, gain, splits): total gain and number of splits of each column."""
        return self.nodes(spark).where("column is not null").groupBy("column").agg(F.sum("gain").alias("gain"), F.count("*").alias("splits"))


def bin_cuts(df: DataFrame, columns: Sequence[str], max_bins: int) -> list[list[float]]:
    """Per column the upper ends of its bins but the last: all values but the largest where they are few, else quantiles."""
    probabilities = [i / max_bins for i in range(1, max_bins)] + [1.0]
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]
    row = df.agg(*[F.percentile_approx(v, probabilities, 100 * max_bins).alias(f"c{i}") for i, v in enumerate(values)]).first()
    return [sorted(set(q))[:-1] if q else [] for q in row]


def _binned(rows: DataFrame, n: int, cuts: list[list[float]]) -> DataFrame:
    """Rows (row_id, y, w, a column per feature) with ``bins`` for the features: the number of cuts below the value, -1 for a missing one."""
    ends = [np.array(c, dtype=np.float64) for c in cuts]
    keep = [f.name for f in rows.schema.fields[:n]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.empty((batch.num_rows, len(ends)), dtype=np.int32)
            for i, at in enumerate(ends):
                x = batch.column(n + i).to_numpy(zero_copy_only=False).astype(np.float64)
                bins[:, i] = np.where(np.isnan(x), -1, np.searchsorted(at, x, side="left"))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + [_lists(bins)], names=[*keep, "bins"])

    return rows.mapInArrow(run, f"{schema}, bins array<int>")


def _lists(x: np.ndarray) -> pa.ListArray:
    """A list per row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


@dataclass
class Steps:
    """A tree on bins: per node the split feature (-1: leaf), the last bin to the left, the direction of missing values, the value."""
    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after at most ``levels`` splits."""
        node = np.ones(len(bins), dtype=np.int64)
        for _ in range(levels):
            going = np.flatnonzero(self.feature[node] >= 0)
            if not len(going):
                break
            at = node[going]
            of = bins[going, self.feature[at]]
            node[going] = 2 * at + ~np.where(of < 0, self.missing_left[at], of <= self.bin[at])
        return node


def _batches(batches: Iterator[pa.RecordBatch], width: int, done: list[Steps], depth: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch with the bins and, the trees in ``done`` added, the margins of its rows."""
    for batch in batches:
        if batch.num_rows:
            bins = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, width)
            margin = batch.column("margin").to_numpy().copy()
            for tree in done:
                margin += tree.value[tree.nodes(bins, depth)]
            yield batch, bins, margin


def _level_sums(rows: DataFrame, chosen: list[int], width: int, sizes: list[int], done: list[Steps], tree: Steps, level: int, depth: int) -> DataFrame:
    """(node, feature, bin, g, h): gradients and hessians of the rows at the nodes of ``level``.

    A task adds up its batches in one array while the cells of the level are
    few, else each batch by the cells that it has.
    """
    first, cells = 1 << level, max(sizes) + 1
    few = len(chosen) * first * cells <= MAX_CELLS

    def made(feature: int, key: np.ndarray, g: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(first + key // cells, pa.int32()), pa.array(np.full(len(key), feature), pa.int32()),
                                           pa.array(key % cells - 1, pa.int32()), pa.array(g), pa.array(h)], names=["node", "feature", "bin", "g", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(chosen), first * cells)) if few else None
        for batch, bins, margin in _batches(batches, width, done, depth):
            node = tree.nodes(bins, level)
            here = np.flatnonzero(node >= first)
            w, y = (batch.column(c).to_numpy()[here] for c in ("w", "y"))
            with np.errstate(over="ignore"):
                probability = 1 / (1 + np.exp(-margin[here]))
            g, h = w * (probability - y), w * probability * (1 - probability)
            at = (node[here] - first) * cells + 1
            for j, f in enumerate(chosen):
                key = at + bins[here, f]
                if few:
                    total[0, j] += np.bincount(key, minlength=first * cells)
                    total[1, j] += np.bincount(key, g, first * cells)
                    total[2, j] += np.bincount(key, h, first * cells)
                else:
                    keys, place = np.unique(key, return_inverse=True)
                    yield made(f, keys, np.bincount(place, g), np.bincount(place, h))
        for j, f in enumerate(chosen if few else []):
            keys = np.flatnonzero(total[0, j])
            yield made(f, keys, total[1, j, keys], total[2, j, keys])

    parts = rows.select("y", "w", "bins", "margin").mapInArrow(run, "node int, feature int, bin int, g double, h double")
    return parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def _with_margins(rows: DataFrame, width: int, done: list[Steps], depth: int) -> DataFrame:
    """``rows`` with the trees in ``done`` added to their margins."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, margin in _batches(batches, width, done, depth):
            yield pa.RecordBatch.from_arrays([pa.array(margin) if c == "margin" else batch.column(c) for c in names], names=names)

    return rows.mapInArrow(run, rows.schema)


def best_splits(sums: DataFrame, gamma: float, least: float, reg: float) -> DataFrame:
    """The best split of each node from sums (node, feature, bin, g, h): (node, feature, bin, missing_left, gain, gl, hl, gr, hr, g, h).

    Of equal gains (to DIGITS decimals) the lowest feature, bin and missing
    values to the right win.  Nodes without a split above 0 have NULLs.
    """
    per = Window.partitionBy("node", "feature")
    upto = per.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    present = F.col("bin") >= 0
    s = sums.withColumns({
        "all_g": F.sum("g").over(per), "all_h": F.sum("h").over(per),
        "none_g": F.sum(F.when(present, 0.0).otherwise(F.col("g"))).over(per), "none_h": F.sum(F.when(present, 0.0).otherwise(F.col("h"))).over(per),
        "low_g": F.sum(F.when(present, F.col("g")).otherwise(0.0)).over(upto), "low_h": F.sum(F.when(present, F.col("h")).otherwise(0.0)).over(upto)})
    way = F.explode(F.array(F.lit(False), F.lit(True))).alias("missing_left")
    s = s.select("node", "feature", "bin", "all_g", "all_h", "none_g", "none_h", "low_g", "low_h", way)
    s = s.withColumns({"gl": F.col("low_g") + F.when(F.col("missing_left"), F.col("none_g")).otherwise(0.0),
                       "hl": F.col("low_h") + F.when(F.col("missing_left"), F.col("none_h")).otherwise(0.0)})
    s = s.withColumns({"gr": F.col("all_g") - F.col("gl"), "hr": F.col("all_h") - F.col("hl")})

    def part(g: str, h: str) -> Column:
        return F.col(g) * F.col(g) / (F.col(h) + reg)

    gain = F.round((part("gl", "hl") + part("gr", "hr") - part("all_g", "all_h")) / 2 - gamma, DIGITS)
    fits = present & (F.col("hl") >= least) & (F.col("hr") >= least) & (F.col("hl") > 0) & (F.col("hr") > 0) & (gain > 0)
    choice = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (~F.col("missing_left")).alias("r"),
                      "gl", "hl", "gr", "hr")
    best = s.groupBy("node").agg(F.max(F.when(fits, choice)).alias("x"), F.first("all_g").alias("g"), F.first("all_h").alias("h"))
    return best.select("node", (-F.col("x.f")).alias("feature"), (-F.col("x.b")).alias("bin"), (~F.col("x.r")).alias("missing_left"),
                       *[F.col(f"x.{c}").alias(c) for c in ("gain", "gl", "hl", "gr", "hr")], "g", "h")


def fit(df: DataFrame, columns: Sequence[str], params: dict | None = None, label: str = "label", weight: str | None = None,
        row_id: str = "row_id", max_bins: int = 256, seed: int = schemas.SEED) -> Model:
    """Trees on the numeric ``columns``; NULL and NaN are missing values.

    ``subsample`` draws rows per tree by a hash of ``row_id``,
    ``colsample_bytree`` columns per tree.  Rows without a label are left out.
    """
    p = {**DEFAULTS, **(params or {})}
    depth, reg = int(p["max_depth"]), float(p["reg_lambda"])
    if not 0 < depth <= MAX_DEPTH:
        raise ValueError(f"max_depth {depth}: 1 to {MAX_DEPTH}")
    df = df.where(F.col(label).isNotNull())
    model = Model(list(columns), bin_cuts(df, columns, max_bins))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    kept = df.select(F.col(row_id).alias("row_id"), F.col(label).cast("double").alias("y"), w.alias("w"), F.lit(0.0).alias("margin"),
                     *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)])
    rows = cut_lineage(_binned(kept, 4, model.cuts))
    rng = random.Random(seed)
    done: list[Steps] = []  # trees that the rows' margins don't hold yet
    for t in range(int(p["n_estimators"])):
        chosen = sorted(rng.sample(range(len(columns)), max(1, math.ceil(float(p["colsample_bytree"]) * len(columns)))))
        tree, steps = _grow(rows, chosen, model.cuts, depth, p, seed + t, reg, done)
        model.trees.append(tree)
        done.append(steps)
        if t % CUT_EVERY == CUT_EVERY - 1 and t + 1 < int(p["n_estimators"]):
            rows, done = cut_lineage(_with_margins(rows, len(columns), done, depth)), []
    return model


def _grow(rows: DataFrame, chosen: list[int], cuts: list[list[float]], depth: int, p: dict, seed: int, reg: float, done: list[Steps]) -> tuple[Tree, Steps]:
    size = 1 << (depth + 1)
    tree = Tree(np.full(size, -1), np.full(size, np.nan), np.zeros(size, bool), np.zeros(size), np.zeros(size))
    steps = Steps(tree.feature, np.zeros(size, dtype=np.int64), tree.missing_left, tree.value)
    rate, sizes = float(p["learning_rate"]), [len(c) + 1 for c in cuts]
    seen = rows.where(uniform01("row_id", seed) < float(p["subsample"])) if float(p["subsample"]) < 1 else rows
    for level in range(depth):
        sums = _level_sums(seen, chosen, len(cuts), sizes, done, steps, level, depth)
        split = False
        for s in best_splits(sums, float(p["gamma"]), float(p["min_child_weight"]), reg).collect():  # a row per node
            if level == 0:
                tree.value[1] = -rate * s.g / (s.h + reg)
            if s.gain is None:
                continue
            split = True
            steps.bin[s.node] = s.bin
            tree.feature[s.node], tree.missing_left[s.node], tree.gain[s.node] = s.feature, s.missing_left, s.gain
            tree.cut[s.node] = cuts[s.feature][s.bin] if s.bin < len(cuts[s.feature]) else math.inf
            tree.value[2 * s.node], tree.value[2 * s.node + 1] = -rate * s.gl / (s.hl + reg), -rate * s.gr / (s.hr + reg)
        if not split:
            break
    return tree, steps


def _walk(model: Model, x: np.ndarray) -> Iterator[tuple[Tree, np.ndarray, np.ndarray, np.ndarray]]:
    """Per tree, level by level: the rows that go on, their nodes and the ones they go to; at the end all rows at their leaves."""
    for tree in model.trees:
        node = np.ones(len(x), dtype=np.int64)
        while True:
            going = np.flatnonzero(tree.feature[node] >= 0)
            if not len(going):
                yield tree, going, node, node
                break
            at = node[going]
            value = x[going, tree.feature[at]]
            with np.errstate(invalid="ignore"):
                left = np.where(np.isnan(value), tree.missing_left[at], value <= tree.cut[at]).astype(bool)
            node[going] = 2 * at + ~left
            yield tree, going, at, node[going]


def _scored(df: DataFrame, model: Model, keep: Sequence[str], fields: str, work) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # a broadcast object would be pickled by reference
    n, names = len(keep), [*keep, *[f.split()[0] for f in fields.split(", ")]]
    rows = df.select(*[F.col(c) for c in keep], *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(model.columns)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(held.value)
        for batch in batches:
            x = np.stack([batch.column(n + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(model.columns))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + work(model, x), names=names)

    return rows.mapInArrow(run, f"{schema}, {fields}")


def predict(df: DataFrame, model: Model, keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
    """``keep`` of every row with margin, probability of class 1 and prediction (M4)."""
    def work(m: Model, x: np.ndarray) -> list[pa.Array]:
        margin = np.full(len(x), m.bias)
        for tree, going, node, _ in _walk(m, x):
            if not len(going):
                margin += tree.value[node]
        probability = 1 / (1 + np.exp(-margin))
        return [pa.array(margin), pa.array(probability), pa.array((probability > 0.5).astype(np.int32))]

    return _scored(df, model, keep, "margin double, probability double, prediction int", work)


def contributions(df: DataFrame, model: Model, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """``keep`` of every row with ``base`` and ``contribution`` (array, one per model column): they add up to the margin.

    Each step down a tree gives the change of the node's value to the column
    that it splits on; ``base`` is the bias and the roots' values.
    """
    def work(m: Model, x: np.ndarray) -> list[pa.Array]:
        out, base = np.zeros((len(x), len(m.columns))), m.bias + sum(float(t.value[1]) for t in m.trees)
        for tree, going, node, to in _walk(m, x):
            np.add.at(out, (going, tree.feature[node[:len(going)]]), tree.value[to[:len(going)]] - tree.value[node[:len(going)]])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(m.columns), pa.int32()), pa.array(out.ravel()))
        return [pa.array(np.full(len(x), base)), lists]

    return _scored(df, model, keep, "base double, contribution array<double>", work)
