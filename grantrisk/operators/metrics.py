"""Evaluation tables: confusion counts, scores, exact ROC/PR areas and
curves, metric pivots, fold summaries and class histograms.

(A6-A9, E1-E9, F8.)  Curves and areas are computed from a table grouped by
score (ties collapse into one row), with running sums from
:mod:`grantrisk.operators.ranking`, so no step sends all rows to one task.
``BinaryClassificationEvaluator`` is not used for areas: it down-samples to
1000 bins and its PR area is trapezoidal, while the required areas are exact
(ties counted half for ROC, step rule for average precision).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantrisk.operators import ranking
from grantrisk.session import cut_lineage

METRIC_NAMES = ["ACU", "SEN", "ESP", "PRE", "F-measure", "AUC"]


def _groups(group: str | Sequence[str] | None) -> list[str]:
    if group is None:
        return []
    return [group] if isinstance(group, str) else list(group)


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction",
              group: str | Sequence[str] | None = None) -> DataFrame:
    """Tn, fp, fn, tp in one pass (per group)."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*_groups(group)).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def score_columns(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """F8: accuracy, precision, recall, specificity, F; 0/0 -> NULL."""
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    precision = d(tp, tp + fp)
    recall = d(tp, tp + fn)
    return {
        "accuracy": d(tp + tn, tp + tn + fp + fn),
        "precision": precision,
        "recall": recall,
        "specificity": d(tn, tn + fp),
        "f_measure": F.try_divide(F.lit(2.0) * precision * recall, precision + recall),
    }


def hard_scores(df: DataFrame, label: str = "label", pred: str = "prediction",
                group: str | Sequence[str] | None = None) -> DataFrame:
    """Confusion counts plus the five hard-label scores."""
    c = confusion(df, label, pred, group)
    return c.withColumns(score_columns(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")))


def score_groups(df: DataFrame, label: str = "label", score: str = "probability",
                 group: str | Sequence[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """Per (group, distinct score): tp, fp, and running cumTP/cumFP in
    descending score order, plus class totals P and N of the group."""
    gs = _groups(group)
    y = F.col(label)
    g = df.groupBy(*gs, F.col(score).alias("score")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("tp"),
        F.sum(F.when(y == 0, 1).otherwise(0)).cast("bigint").alias("fp"),
    )
    g = cut_lineage(g)  # cuts, bucket totals, running sums and class totals all read it
    g = ranking.quantile_bucket(g, "score", n_buckets, descending=True)
    g = ranking.running_sums(g, [F.col("score").desc()],
                             {"cum_tp": F.col("tp"), "cum_fp": F.col("fp")}, "__bucket", gs)
    totals = g.groupBy(*gs).agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"))
    # One row per group (classifier): bounded by the number of groups.
    if gs:
        same = None
        for i, c in enumerate(gs):
            totals = totals.withColumnRenamed(c, f"__g{i}")
            one = F.col(c).eqNullSafe(F.col(f"__g{i}"))
            same = one if same is None else same & one
        g = g.join(F.broadcast(totals), same).drop(*[f"__g{i}" for i in range(len(gs))])
    else:
        t = totals.first()
        p_, n_ = (t["P"], t["N"]) if t is not None else (0, 0)
        g = g.withColumns({"P": F.lit(p_).cast("bigint"), "N": F.lit(n_).cast("bigint")})
    return g.drop("__bucket")


def roc_auc(df: DataFrame, label: str = "label", score: str = "probability",
            group: str | Sequence[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve (ties count one half)."""
    gs = _groups(group)
    g = score_groups(df, label, score, gs)
    term = F.col("fp") * (F.col("cum_tp") - F.col("tp") + F.col("tp") / F.lit(2.0))
    return g.groupBy(*gs).agg(
        F.try_divide(F.sum(term), F.first("P").cast("double") * F.first("N").cast("double"))
        .alias("roc_auc"))


def average_precision(df: DataFrame, label: str = "label", score: str = "probability",
                      group: str | Sequence[str] | None = None) -> DataFrame:
    """Average precision, sum over thresholds of (delta recall) x precision."""
    gs = _groups(group)
    g = score_groups(df, label, score, gs)
    term = (F.col("tp") / F.col("P")) * (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp")))
    return g.groupBy(*gs).agg(F.sum(term).alias("avg_precision"))


def roc_points(df: DataFrame, label: str = "label", score: str = "probability",
               group: str | Sequence[str] | None = None) -> DataFrame:
    """Every ROC point (threshold, fpr, tpr) plus the (0, 0) start."""
    gs = _groups(group)
    g = score_groups(df, label, score, gs)
    pts = g.select(*gs, F.col("score").alias("threshold"),
                   F.try_divide(F.col("cum_fp").cast("double"), F.col("N")).alias("fpr"),
                   F.try_divide(F.col("cum_tp").cast("double"), F.col("P")).alias("tpr"))
    start = g.select(*gs).distinct().select(*gs, F.lit(None).cast("double").alias("threshold"),
                                             F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def pr_points(df: DataFrame, label: str = "label", score: str = "probability",
              group: str | Sequence[str] | None = None) -> DataFrame:
    """E5: every precision-recall point plus the (recall 0, precision 1) end."""
    gs = _groups(group)
    g = score_groups(df, label, score, gs)
    pts = g.select(*gs, F.col("score").alias("threshold"),
                   F.try_divide(F.col("cum_tp").cast("double"),
                                F.col("cum_tp") + F.col("cum_fp")).alias("precision"),
                   F.try_divide(F.col("cum_tp").cast("double"), F.col("P")).alias("recall"))
    end = g.select(*gs).distinct().select(*gs, F.lit(None).cast("double").alias("threshold"),
                                           F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def metric_long(df: DataFrame, label: str = "label", pred: str = "prediction",
                score: str = "probability", group: str = "classifier") -> DataFrame:
    """Long metric table (group, metric, value) with the report's metric names."""
    hs = hard_scores(df, label, pred, group)
    auc = roc_auc(df, label, score, group)
    j = hs.join(auc.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")
    pairs = {"ACU": "accuracy", "SEN": "recall", "ESP": "specificity", "PRE": "precision",
             "F-measure": "f_measure", "AUC": "roc_auc"}
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(v).alias("value"))
                                for k, v in pairs.items()]))
    return j.select(group, stack.alias("m")).select(group, "m.metric", "m.value")


def metric_pivot(long: DataFrame, group: str = "classifier",
                 metrics: Sequence[str] = METRIC_NAMES) -> DataFrame:
    """One row per model, one column per metric (fixed column list)."""
    return long.groupBy(group).pivot("metric", list(metrics)).agg(F.first("value"))


def fold_summary(fold_metrics: DataFrame, keys: Sequence[str] = ("classifier", "metric"),
                 value: str = "value") -> DataFrame:
    """Mean and sample deviation of per-fold metrics."""
    return fold_metrics.groupBy(*keys).agg(F.avg(value).alias("mean"),
                                           F.stddev_samp(value).alias("stdev"))


def misclassified(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """False positives and false negatives, by row id."""
    return df.filter(F.col(pred) != F.col(label)).withColumn(
        "kind", F.when(F.col(label) == 0, F.lit("FP")).otherwise(F.lit("FN")))


def class_histogram(df: DataFrame, value: str, label: str, n_bins: int, group: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram per class (and ``group``) over its own min..max.

    Returns every bin (empty ones with n = 0): (group, label, bin, lo, hi, n).
    The last bin is closed on the right.  The range table has one row per
    class and group and is joined without a hint, so it is broadcast only
    where it is measured to be small.
    """
    keys = [*group, label]
    x = F.col(value).cast("double")
    rng = df.filter(x.isNotNull()).groupBy(*keys).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    width = F.col("__hi") - F.col("__lo")
    def same(other: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Column]:
        """``other`` with its key columns renamed, and the condition that they are equal, NULL with NULL."""
        renamed = other.withColumnsRenamed({c: f"__k{i}" for i, c in enumerate(names)})
        return renamed, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)])

    binned = df.filter(x.isNotNull()).join(*same(rng, keys)).select(
        *keys,
        F.when(width == 0, F.lit(0)).otherwise(
            F.least(F.lit(n_bins - 1),
                    F.floor((x - F.col("__lo")) * F.lit(n_bins) / width).cast("int"))).alias("bin"))
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = rng.select(*keys, "__lo", "__hi",
                      F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    step = (F.col("__hi") - F.col("__lo")) / F.lit(float(n_bins))
    out = bins.join(*same(counts, [*keys, "bin"]), "left").select(
        *keys, "bin",
        (F.col("__lo") + F.col("bin") * step).alias("lo"),
        (F.col("__lo") + (F.col("bin") + 1) * step).alias("hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))
    return out


def cumulative_histogram(hist: DataFrame, label: str, reverse_labels: Sequence[int] = (0,),
                         group: Sequence[str] = ()) -> DataFrame:
    """Normalised cumulative histogram; reversed for ``reverse_labels``.

    Operates on the (classes x bins) table, which is bounded by the bin
    count, so its per-class window is small.
    """
    tot = F.sum("n").over(Window.partitionBy(*group, label))
    fwd = Window.partitionBy(*group, label).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bwd = Window.partitionBy(*group, label).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rev = F.col(label).isin(list(reverse_labels))
    return hist.withColumn("cumulative", F.when(rev, F.sum("n").over(bwd)).otherwise(F.sum("n").over(fwd))
                           / tot)
