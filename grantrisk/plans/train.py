"""Training pipeline: feature table -> matrices -> models -> metric table.

For each feature-set variant: model input (P8), category codes and numeric
statistics (G3-G9), vector matrices for trees (ordinal codes) and linear
models (standardised + one-hot), a stratified hold-out (R1), class weights
(R7), then the default / tuned / resampled phases of the experiment (M13).
Category lists are taken from all rows (so the test part never holds an
unknown category), as in the original experiment.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantrisk import schemas
from grantrisk.operators import balance as bal
from grantrisk.operators import adaptive, learn, many, perceptron
from grantrisk.operators import prepare as prep
from grantrisk.operators import relational as rel
from grantrisk.plans import etl
from grantrisk.session import cut_lineage

ROW_ID, LABEL = "row_id", "label"


class Matrices:
    """The matrices of a variant, (row_id, label, features, weight, split) each; one is made when it is first asked for."""

    def __init__(self, variant: str, tree: Callable[[], DataFrame], linear: Callable[[], DataFrame], names: Callable[[str], DataFrame]):
        self.variant, self._tree, self._linear, self._names = variant, tree, linear, names

    @cached_property
    def tree(self) -> DataFrame:
        return self._tree()

    @cached_property
    def linear(self) -> DataFrame:
        return self._linear()

    @cached_property
    def tree_names(self) -> DataFrame:  # idx, name
        return self._names("tree")

    @cached_property
    def linear_names(self) -> DataFrame:
        return self._names("linear")


def model_frame(features: DataFrame, variant: str, agency: str | None = None) -> DataFrame:
    mi = etl.model_input(features).filter(F.col("TARGET").isNotNull())
    mi = mi.withColumn(ROW_ID, F.col("NR_CONVENIO").cast("bigint")) \
           .withColumn(LABEL, F.col("TARGET").cast("int")).drop("NR_CONVENIO", "TARGET")
    return rel.feature_variant(mi, variant, agency=agency)


def build_matrices(features: DataFrame, variant: str, checkpoint: bool = True,
                   pos_weight: float = schemas.DEFAULT_POS_WEIGHT, fit_on: str = "train") -> Matrices:
    """Matrices of one variant, split and weighted.

    ``fit_on``: rows from which means and deviations are taken, ``"train"``
    or, as the original experiment did, ``"all"``.  Category codes always
    cover all rows, so the test part has no unknown category.
    """
    if fit_on not in ("train", "all"):
        raise ValueError(f"fit_on {fit_on!r}")
    # the feature pipeline runs once; the split's passes read the checkpoint
    mi = cut_lineage(model_frame(features, variant))
    num = [c for c in schemas.NUMERIC_FEATURES if c in mi.columns]
    cat = [c for c in schemas.CATEGORICAL_FEATURES if c in mi.columns]
    mi = cut_lineage(bal.holdout_split(mi, LABEL, ROW_ID))
    codes = cut_lineage(prep.first_seen_codes(mi, cat, ROW_ID))  # one code table for both matrices
    fit_rows = mi.filter(F.col("split") == "train") if fit_on == "train" else mi

    def tree() -> DataFrame:
        model, _ = prep.tree_pipeline(fit_rows, num, cat, ROW_ID, codes=codes)
        rows = learn.strip_nominal(model.transform(mi)).select(ROW_ID, LABEL, "features", "split")
        rows = bal.class_weights(rows, LABEL, mode="pos", pos_weight=pos_weight)
        return cut_lineage(rows) if checkpoint else rows

    def linear() -> DataFrame:
        model, _ = prep.linear_pipeline(fit_rows, num, cat, ROW_ID, codes=codes)
        rows = bal.class_weights(mi, LABEL, mode="balanced")  # before the vectors, which are staged once
        return model.transform(rows, [ROW_ID, LABEL, "split", "weight"]).select(ROW_ID, LABEL, "features", "split", "weight")

    return Matrices(variant, tree, linear, lambda kind: prep.feature_names(codes, num, cat, kind))


def reweighted(data: DataFrame, params: dict | None) -> DataFrame:
    """``scale_pos_weight`` among the parameters sets the weight of positive rows."""
    if "scale_pos_weight" not in (params or {}):
        return data
    return bal.class_weights(data.drop("weight"), LABEL, mode="pos", pos_weight=float(params["scale_pos_weight"]))


def make_estimator(kind: str, params: dict | None, train: DataFrame):
    if kind == "gbt":
        return learn.gbt(params)
    if kind == "logit":
        return learn.logit(params, n_rows=train.count())
    if kind == "mlp":
        return perceptron.Perceptron(params, n_features=learn.vector_width(train))
    raise ValueError(kind)


def fit_eval(kind: str, params: dict | None, m: Matrices, train: DataFrame | None = None) -> tuple:
    data = m.tree if kind == "gbt" else m.linear
    tr = train if train is not None else data.filter(F.col("split") == "train")
    te = data.filter(F.col("split") == "test")
    if kind == "gbt":
        tr = reweighted(tr, params)
    model = make_estimator(kind, params, tr).fit(tr)
    pred = learn.predict(model, te)
    return model, pred, learn.metric_rows(pred, kind)


def resampled_train(data: DataFrame, method: str, ratio: float, pos_weight: float | None) -> DataFrame:
    """Training part rebalanced by R3-R5; the vectors stay as they are, sparse ones sparse."""
    tr = data.filter(F.col("split") == "train").select(ROW_ID, LABEL, "features")
    res = bal.resample(tr, method, ratio, label=LABEL, row_id=ROW_ID, vec="features")
    out = res.select(ROW_ID, LABEL, "features", F.lit("train").alias("split"))
    if pos_weight is None:
        return bal.class_weights(out, LABEL, mode="balanced")
    return bal.class_weights(out, LABEL, mode="pos", pos_weight=pos_weight)


SPACES = {"gbt": learn.GBT_SPACE, "logit": learn.LOGIT_SPACE, "mlp": learn.MLP_SPACE}


def tune(kind: str, m: Matrices, n_iter: int = 20, folds: int = schemas.N_FOLDS, metric: str = "roc_auc",
         seed: int = schemas.SEED, base: dict | None = None, ledger: str | None = None, law: str = "random") -> tuple[dict, DataFrame]:
    """Seeded search of ``kind`` on the training part.

    ``law``: "random" draws all candidates at once, "adaptive" proposes each
    from the scores before it (:mod:`grantrisk.operators.adaptive`).

    Logistic candidates and folds are fitted together in the passes of one
    fit (:mod:`grantrisk.operators.many`); the others one after the other,
    kept in ``ledger`` (a folder) if one is given.

    Returns the best parameters (on top of ``base``) and the trials table.
    As in the original search, the positive weight is not part of the best
    parameters, so the boosted tree keeps its default weight when refitted.
    """
    data = (m.tree if kind == "gbt" else m.linear).filter(F.col("split") == "train")
    folded = cut_lineage(bal.stratified_folds(data, LABEL, ROW_ID, k=folds))
    cands = [{**(base or {}), **c} for c in learn.draw_candidates(SPACES[kind], n_iter, seed)]
    rows_packed = many.pack(folded) if kind == "logit" else None

    def scored(some: list[dict]) -> DataFrame:
        if kind == "logit":
            return many.search_logit(rows_packed, some, metric, k=folds)
        return learn.search(folded.sparkSession, lambda c, tr: make_estimator(kind, c, tr), some, folded, metric=metric, k=folds,
                            ledger=ledger, tag=kind)

    if law == "adaptive":
        pairs = adaptive.search(lambda c: scored([c]).first()["score"], {**(base or {}), **SPACES[kind]}, n_iter, seed)
        names = list(pairs[0][0])
        rows = [(i, float(s), *[float(c[p]) for p in names]) for i, (c, s) in enumerate(pairs)]
        trials = folded.sparkSession.createDataFrame(rows, "trial int, score double" + "".join(f", {p} double" for p in names))
    else:
        trials = scored(cands)
    return learn.best_candidate(trials), trials


def grid_search(m: Matrices, grid: dict | None = None, folds: int = schemas.N_FOLDS, metric: str = "roc_auc",
                ledger: str | None = None) -> DataFrame:
    """M7: trials of the boosted-tree grid (default: all 90 candidates, ten folds) on the training part.

    Candidates that differ in ``n_estimators`` only are scored from one fit.
    ``ledger``: see ``learn.search``.
    """
    folded = cut_lineage(bal.stratified_folds(m.tree.filter(F.col("split") == "train"), LABEL, ROW_ID, k=folds))
    cands = learn.grid_candidates(grid or learn.GBT_GRID)
    return learn.search(folded.sparkSession, lambda c, tr: learn.gbt(c), cands, folded, metric=metric, k=folds,
                        ledger=ledger, tag="gbt", rounds="n_estimators")


def random_search(m: Matrices, n: int = 10, folds: int = schemas.N_FOLDS, metric: str = "recall",
                  seed: int = schemas.SEED, ledger: str | None = None, space: dict | None = None) -> DataFrame:
    """M8: trials of ``n`` seeded draws of boosted trees (default: ten draws, ten folds, scored by recall).

    ``ledger``: see ``learn.search``; ``space``: other distributions than ``learn.GBT_RANDOM_SPACE``.
    """
    folded = cut_lineage(bal.stratified_folds(m.tree.filter(F.col("split") == "train"), LABEL, ROW_ID, k=folds))
    cands = learn.draw_candidates(space or learn.GBT_RANDOM_SPACE, n, seed)
    return learn.search(folded.sparkSession, lambda c, tr: learn.gbt(c), cands, folded, metric=metric, k=folds,
                        ledger=ledger, tag="gbt")


def _tag(rows: DataFrame, variant: str, phase: str, ratio=None, method=None) -> DataFrame:
    return rows.select(F.lit(variant).alias("variant"), F.lit(phase).alias("phase"),
                       F.lit(ratio).cast("double").alias("ratio"), F.lit(method).cast("string").alias("resampler"),
                       F.col("classifier"), "metric", "value")


def experiment(features: DataFrame, variants=("all", "sem_municipio", "sem_municipio_orgao"),
               models=("gbt", "logit", "mlp"), params: dict | None = None,
               resample: list[tuple[str, float]] | None = None,
               resample_variants=None, resample_models=None,
               tune_iter: int = 0, tune_folds: int = schemas.N_FOLDS) -> DataFrame:
    """Long metric table (variant, phase, ratio, resampler, classifier, metric, value).

    Phases: ``default`` (``params`` per model kind), ``tuned`` when
    ``tune_iter`` > 0 (seeded search, best refit), and ``resampled`` for
    each (method, ratio) of ``resample`` — training part only, test part
    untouched, using the tuned parameters when there are any and, for the
    boosted tree, a positive weight equal to the inverse of the ratio.
    An infeasible ratio gives one row with metric ``infeasible`` and no value;
    ``resample_variants`` / ``resample_models`` restrict that phase.
    """
    params = params or {}
    parts = []
    features = cut_lineage(features)  # once for all variants
    for v in variants:
        m = build_matrices(features, v)
        for kind in models:
            _, _, rows = fit_eval(kind, params.get(kind), m)
            parts.append(_tag(rows, v, "default"))
            chosen = dict(params.get(kind) or {})
            if tune_iter > 0:
                chosen, _ = tune(kind, m, tune_iter, tune_folds, base=params.get(kind))
                _, _, rows = fit_eval(kind, chosen, m)
                parts.append(_tag(rows, v, "tuned"))
            do_resample = (resample_variants is None or v in resample_variants) and \
                (resample_models is None or kind in resample_models)
            for method, ratio in (resample or []) if do_resample else []:
                data = m.tree if kind == "gbt" else m.linear
                w = (1.0 / ratio) if kind == "gbt" else None
                try:
                    tr = resampled_train(data, method, ratio, w)
                except bal.InfeasibleRatio:
                    none = data.sparkSession.createDataFrame([(kind, "infeasible", None)], "classifier string, metric string, value double")
                    parts.append(_tag(none, v, "resampled", float(ratio), method))
                    continue
                p = dict(chosen)
                if kind == "gbt":
                    p["scale_pos_weight"] = 1.0 / ratio
                _, _, rows = fit_eval(kind, p, m, train=tr)
                parts.append(_tag(rows, v, "resampled", float(ratio), method))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
