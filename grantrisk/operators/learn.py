"""Learning and search (M1-M13) on Spark ML.

* M1 boosted trees -> ``GBTClassifier`` (positive-class weight as ``weightCol``)
* M2 logistic regression (elastic net, balanced weights) -> ``LogisticRegression``
* M3 multilayer perceptron -> ``MultilayerPerceptronClassifier``
* M4 predictions (row id, label, P(class 1), hard class)
* M5/M6 k-fold scores with exact metrics, M7 grid, M8/M9 seeded random
  search over declared distributions, M10 trials table, M11 best refit,
  M12 named importances, M13 experiment matrix.

Every fit is a distributed Spark ML job; the driver only loops over
candidates/folds (bounded by the search budget) and receives metric rows.
Training matrices are cut from their lineage with a reliable checkpoint
first, so iterative learners do not replay the ETL and survive executor loss.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import SparkContext
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantrisk import schemas
from grantrisk.operators import metrics as mx

# Reference defaults of the three classifiers (fixed values).
GBT_DEFAULTS = {"n_estimators": 150, "max_depth": 6, "learning_rate": 0.3, "subsample": 1.0,
                "colsample_bytree": 1.0, "gamma": 0.0, "min_child_weight": 1,
                "scale_pos_weight": schemas.DEFAULT_POS_WEIGHT}
LOGIT_DEFAULTS = {"C": 1.0, "l1_ratio": 0.0, "fit_intercept": True}
MLP_DEFAULTS = {"hidden_layer_sizes": 100, "max_iter": 500, "tol": 1e-4}
# Grid of the boosted-tree grid search: 3 rates x 6 depths x 5 sizes.
GBT_GRID = {"learning_rate": [0.001, 0.01, 0.1], "max_depth": [5, 6, 7, 8, 10, 12],
            "n_estimators": [50, 100, 150, 200, 250]}


# -- parameter maps ---------------------------------------------------------------

def strip_nominal(df: DataFrame, col: str = "features") -> DataFrame:
    """Drop ML attribute metadata so ordinal codes are split as numbers
    (as a gradient-boosting library does), not as unordered categories."""
    return df.withColumn(col, F.col(col).alias(col, metadata={}))


def gbt(params: dict | None = None, features: str = "features", label: str = "label",
        weight: str | None = "weight", seed: int = schemas.SEED, max_bins: int = 256) -> GBTClassifier:
    """M1: GBT from boosted-tree parameters.

    n_estimators->maxIter, max_depth->maxDepth (above 30, Spark's limit, is an
    error), learning_rate->stepSize, max_bins->maxBins (split candidates per
    feature; features with more values are cut at quantiles),
    subsample->subsamplingRate, colsample_bytree->featureSubsetStrategy (per
    node), gamma->minInfoGain, min_child_weight->minInstancesPerNode; the
    positive weight travels in ``weight`` (see ``class_weights(mode='pos')``).
    """
    p = {**GBT_DEFAULTS, **(params or {})}
    if int(p["max_depth"]) > 30:
        raise ValueError(f"max_depth {p['max_depth']}: trees are at most 30 deep")
    est = GBTClassifier(featuresCol=features, labelCol=label, seed=seed,
                        maxIter=int(p["n_estimators"]), maxDepth=int(p["max_depth"]),
                        stepSize=float(p["learning_rate"]), subsamplingRate=float(p["subsample"]),
                        featureSubsetStrategy=str(float(p["colsample_bytree"]))
                        if float(p["colsample_bytree"]) < 1.0 else "all",
                        minInfoGain=float(p["gamma"]), minInstancesPerNode=max(1, int(p["min_child_weight"])),
                        maxBins=max_bins, checkpointInterval=10,
                        # node-id caching pays off only for deep trees; shallow
                        # trees are cheaper to ship to the executors
                        cacheNodeIds=int(p["max_depth"]) > 10)
    if weight:
        est.setWeightCol(weight)
    return est


def logit(params: dict | None = None, n_rows: int = 1, features: str = "features",
          label: str = "label", weight: str | None = "weight") -> LogisticRegression:
    """M2: C -> regParam = 1 / (C n), l1_ratio -> elasticNetParam."""
    p = {**LOGIT_DEFAULTS, **(params or {})}
    est = LogisticRegression(featuresCol=features, labelCol=label, maxIter=100,
                             regParam=1.0 / (float(p["C"]) * max(1, n_rows)),
                             elasticNetParam=float(p["l1_ratio"]),
                             fitIntercept=bool(p["fit_intercept"]), standardization=False)
    if weight:
        est.setWeightCol(weight)
    return est


def mlp(params: dict | None = None, n_features: int = 1, features: str = "features",
        label: str = "label", seed: int = schemas.SEED) -> MultilayerPerceptronClassifier:
    """M3: one hidden layer of sigmoid units.

    Without ``learning_rate_init`` the solver is L-BFGS, which has no rate;
    with one it is gradient descent at that rate.
    """
    p = {**MLP_DEFAULTS, **(params or {})}
    rate = p.get("learning_rate_init")
    solver = {"solver": "l-bfgs"} if rate is None else {"solver": "gd", "stepSize": float(rate)}
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, seed=seed,
                                          layers=[n_features, int(p["hidden_layer_sizes"]), 2],
                                          maxIter=int(p["max_iter"]), tol=float(p["tol"]), **solver)


def vector_width(df: DataFrame, col: str = "features") -> int:
    meta = df.schema[col].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    return len(df.select(col).first()[col])


# -- predictions and scores ------------------------------------------------------------

def predict(model, df: DataFrame, row_id: str = "row_id", label: str = "label") -> DataFrame:
    """M4: (row_id, label, probability of class 1, prediction)."""
    out = model.transform(df)
    return out.select(F.col(row_id).alias("row_id"), F.col(label).cast("int").alias("label"),
                      vector_to_array("probability")[1].alias("probability"),
                      F.col("prediction").cast("int").alias("prediction"))


def score(pred: DataFrame, metric: str) -> float:
    """One exact metric of a prediction table (distributed; one row back)."""
    if metric == "roc_auc":
        r = mx.roc_auc(pred).first()
        return r["roc_auc"]
    if metric == "average_precision":
        return mx.average_precision(pred).first()["avg_precision"]
    hs = mx.hard_scores(pred).first()
    return hs[metric]


def metric_rows(pred: DataFrame, classifier: str) -> DataFrame:
    """E1 + E2 of one prediction table as (classifier, metric, value)."""
    return mx.metric_long(pred.withColumn("classifier", F.lit(classifier)))


# -- k-fold, grid and random search --------------------------------------------------

def kfold_metrics(make: Callable[[DataFrame], Any], df: DataFrame, fold: str = "fold",
                  k: int = schemas.N_FOLDS, classifier: str = "model", parallelism: int = 2,
                  row_id: str = "row_id", label: str = "label") -> DataFrame:
    """M6: fit on k-1 folds, score the held-out fold, six metrics per fold."""
    def one(f: int) -> DataFrame:
        tr, va = df.filter(F.col(fold) != f), df.filter(F.col(fold) == f)
        model = make(tr).fit(tr)
        pred = predict(model, va, row_id, label)
        rows = metric_rows(pred, classifier).collect()  # six rows
        return [(classifier, f, r["metric"], r["value"]) for r in rows]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        res = [row for part in ex.map(one, range(k)) for row in part]
    return df.sparkSession.createDataFrame(res, "classifier string, fold int, metric string, value double")


def cv_score(make: Callable[[DataFrame], Any], df: DataFrame, metric: str = "roc_auc",
             fold: str = "fold", k: int = schemas.N_FOLDS, parallelism: int = 2,
             row_id: str = "row_id", label: str = "label", ledger: Ledger | None = None, key: str = "") -> float:
    """M5: mean k-fold score of one candidate; NaN when a fold's score is undefined.

    With a ``ledger`` folds that it has under ``key`` aren't fitted again, and each other one is written to it.
    """
    return cv_scores(make, df, {key: None}, metric, fold, k, parallelism, row_id, label, ledger)[0]


def cv_scores(make: Callable[[DataFrame], Any], df: DataFrame, rounds: dict[str, int | None], metric: str = "roc_auc",
              fold: str = "fold", k: int = schemas.N_FOLDS, parallelism: int = 2,
              row_id: str = "row_id", label: str = "label", ledger: Ledger | None = None) -> list[float]:
    """:func:`cv_score` of candidates that one fit serves: ``rounds`` has, for each one's key, the trees that it takes of the fit (None: all)."""
    def one(f: int) -> list[float]:
        known = {key: ledger.scores[key, f] for key in rounds if (key, f) in ledger.scores} if ledger is not None else {}
        if len(known) < len(rounds):
            tr, va = df.filter(F.col(fold) != f), df.filter(F.col(fold) == f)
            model = make(tr).fit(tr)
            for key, n in rounds.items():
                if key not in known:
                    known[key] = score(predict(model if n is None else first_trees(model, n), va, row_id, label), metric)
                    if ledger is not None:
                        ledger.add(key, f, known[key])
        return [known[key] for key in rounds]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        folds = list(ex.map(one, range(k)))
    return [sum(vals) / len(vals) if vals and None not in vals else float("nan") for vals in zip(*folds)] if folds else [float("nan")] * len(rounds)


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model after ``n`` rounds: a round reads the trees before it only, and its seed follows from its number."""
    old = model._java_obj
    if n >= model.getNumTrees:
        return model
    jvm, gateway = SparkContext._active_spark_context._jvm, SparkContext._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i, (tree, weight) in enumerate(zip(list(old.trees())[:n], list(old.treeWeights())[:n])):
        trees[i], weights[i] = tree, float(weight)
    out = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{old.uid()}_{n}", trees, weights, old.numFeatures(), 2))
    return out.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol()).setProbabilityCol(model.getProbabilityCol())


class Ledger:
    """Scores of finished fits in a folder of Parquet tables, one committed row for each (candidate, fold).

    A search that ends midway and is started again reads what is there and
    fits the rest.  Rows are keyed by a digest of everything that a score
    depends on: the candidate, the metric, the folds and the data.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.scores: dict[tuple[str, int], float | None] = {}
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            self.scores = {(r.key, r.fold): r.score for r in spark.read.schema("key string, fold int, score double")
                           .option("recursiveFileLookup", "true").parquet(path).collect()}

    def add(self, key: str, fold: int, value: float | None) -> None:
        self.spark.createDataFrame([(key, fold, value)], "key string, fold int, score double").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/{key}-{fold}")  # a folder each: fits end side by side
        self.scores[key, fold] = value

    @staticmethod
    def key(candidate: dict, metric: str, k: int, data: str) -> str:
        return hashlib.sha256(json.dumps([sorted(candidate.items()), metric, k, data], default=str).encode()).hexdigest()


def data_digest(df: DataFrame, features: str = "features") -> str:
    """Count and sum of the row hashes: the same for the same rows in any order."""
    cols = [F.unwrap_udt(F.col(c)) if c == features and isinstance(df.schema[c].dataType, VectorUDT) else F.col(c) for c in sorted(df.columns)]
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h")).first()
    return f"{r.n}:{r.h}:{','.join(sorted(df.columns))}"


@dataclass(frozen=True)
class Uniform:
    lo: float
    hi: float

    def draw(self, rng: random.Random):
        return rng.uniform(self.lo, self.hi)


@dataclass(frozen=True)
class UniformInt:
    lo: int
    hi: int

    def draw(self, rng: random.Random):
        return rng.randint(self.lo, self.hi)


@dataclass(frozen=True)
class LogUniform:
    lo: float  # natural-log bounds
    hi: float

    def draw(self, rng: random.Random):
        return math.exp(rng.uniform(self.lo, self.hi))


@dataclass(frozen=True)
class Choice:
    options: tuple

    def draw(self, rng: random.Random):
        return self.options[rng.randrange(len(self.options))]


# Search spaces of the tuned-model phase (fixed values).
GBT_SPACE = {"n_estimators": UniformInt(50, 250), "max_depth": UniformInt(1, 14),
             "learning_rate": LogUniform(-5, 0), "min_child_weight": UniformInt(1, 10),
             "subsample": Uniform(0.7, 1.0), "gamma": Uniform(0.5, 1.2),
             "colsample_bytree": Uniform(0.7, 1.0)}
LOGIT_SPACE = {"C": LogUniform(-4 * math.log(10), 4 * math.log(10)),
               "fit_intercept": Choice((False, True)), "l1_ratio": Uniform(0.0, 1.0)}
MLP_SPACE = {"learning_rate_init": LogUniform(-6.9, 0.0), "hidden_layer_sizes": UniformInt(10, 100)}
# Random-search space of the boosted-tree study.
GBT_RANDOM_SPACE = {"learning_rate": Choice(tuple(10 ** (-3 + 3 * i / 9) for i in range(10))),
                    "max_depth": UniformInt(2, 13), "n_estimators": UniformInt(50, 249)}


def draw_candidates(space: dict, n: int, seed: int = schemas.SEED) -> list[dict]:
    """M8/M9: ``n`` seeded draws from declared distributions (driver-side, tiny)."""
    rng = random.Random(seed)
    return [{k: (v.draw(rng) if hasattr(v, "draw") else v) for k, v in space.items()} for _ in range(n)]


def grid_candidates(grid: dict[str, Sequence]) -> list[dict]:
    """M7: cartesian product of the grid values (order: last key fastest)."""
    cands = [{}]
    for k, vals in grid.items():
        cands = [{**c, k: v} for c in cands for v in vals]
    return cands


def search(spark: SparkSession, make_from: Callable[[dict, DataFrame], Any], candidates: list[dict],
           df: DataFrame, metric: str = "roc_auc", fold: str = "fold", k: int = schemas.N_FOLDS,
           parallelism: int = 2, ledger: str | None = None, tag: str = "", rounds: str | None = None) -> DataFrame:
    """K-fold score of every candidate -> trials table (trial, score, params...).

    ``ledger``: a folder that keeps finished fits, so that a search started
    again goes on where it ended; ``tag`` names what ``make_from`` makes.
    ``rounds``: the parameter with the number of boosting rounds; candidates
    that differ in it only are scored from the fit with the most.
    """
    kept = Ledger(spark, ledger) if ledger else None
    data = f"{tag}|{data_digest(df)}" if ledger else ""
    together: dict[str, list[int]] = {}
    for i, cand in enumerate(candidates):
        same = repr(sorted((p, v) for p, v in cand.items() if p != rounds)) if rounds and rounds in cand else str(i)
        together.setdefault(same, []).append(i)
    scores: dict[int, float] = {}
    for members in together.values():
        longest = candidates[members[0]] if len(members) == 1 else max((candidates[i] for i in members), key=lambda c: c[rounds])
        of = {i: Ledger.key(candidates[i], metric, k, data) if kept else str(i) for i in members}
        takes = {of[i]: None if len(members) == 1 else int(candidates[i][rounds]) for i in members}  # equal candidates have one key
        found = dict(zip(takes, cv_scores(lambda tr, c=longest: make_from(c, tr), df, takes, metric, fold, k, parallelism, ledger=kept)))
        scores |= {i: found[of[i]] for i in members}
    rows = [{"trial": i, "score": float(scores[i]), **{p: float(v) for p, v in cand.items()}} for i, cand in enumerate(candidates)]
    keys = list(candidates[0]) if candidates else []
    schema = "trial int, score double" + "".join(f", {p} double" for p in keys)
    return spark.createDataFrame([tuple([r["trial"], r["score"]] + [r[p] for p in keys]) for r in rows], schema)


def best_candidate(trials: DataFrame) -> dict:
    """Parameters of the best trial (highest score, then lowest trial)."""
    score_ = F.nanvl("score", F.lit(None).cast("double"))  # an undefined score never wins
    r = trials.orderBy(score_.desc_nulls_last(), "trial").first()
    return {k: v for k, v in r.asDict().items() if k not in ("trial", "score")}


def importances(model, names: DataFrame, top: int = 10) -> DataFrame:
    """M12 + O3: the ``top`` largest importances, named by the table (idx, name)."""
    imp = model.featureImportances.toArray().tolist()
    df = names.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(imp)], "idx int, importance double")
    df = df.join(names, "idx", "left").select("idx", F.coalesce("name", F.concat(F.lit("f"), "idx")).alias("name"), "importance")
    return df.orderBy(F.col("importance").desc(), "idx").limit(top)


def grid_search_cv(spark: SparkSession, estimator, grid: dict[str, Sequence], df: DataFrame,
                   fold: str = "fold", parallelism: int = 2, seed: int = schemas.SEED) -> DataFrame:
    """M7 with Spark ML's ``CrossValidator``: candidates from ``grid`` (keys
    are estimator parameter names), folds from the ``fold`` column (exact
    stratified folds), candidate fits run ``parallelism`` at a time.  The
    evaluator keeps every threshold (``numBins=0``), so the ROC area is exact.
    Returns the trials table (trial, score, params...)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    b = ParamGridBuilder()
    for name, vals in grid.items():
        b = b.addGrid(estimator.getParam(name), list(vals))
    maps = b.build()
    ev = BinaryClassificationEvaluator(labelCol=estimator.getLabelCol(), rawPredictionCol="rawPrediction",
                                       metricName="areaUnderROC", numBins=0)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=ev, foldCol=fold,
                        parallelism=parallelism, seed=seed)
    model = cv.fit(df.withColumn(fold, F.col(fold).cast("int")))
    keys = list(grid)
    rows = [tuple([i, float(score)] + [float(pm[estimator.getParam(k)]) for k in keys])
            for i, (pm, score) in enumerate(zip(maps, model.avgMetrics))]
    schema = "trial int, score double" + "".join(f", {k} double" for k in keys)
    return spark.createDataFrame(rows, schema)
