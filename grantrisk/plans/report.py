"""Report tables: class balance by group, top groups, value histograms.

The original report pulled whole tables to a client to bin them; here the
binning runs on executors and only bounded outputs (one row per group or per
bin) leave the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grantrisk.operators import metrics as mx
from grantrisk.operators import relational as rel

# The four class-balance reports: (name, group column, rows shown).
BALANCE_REPORTS = {
    "agency": ("COD_ORGAO_SUP", 6),
    "instrument": ("MODALIDADE", 6),
    "account": ("SITUACAO_CONTA", 6),
    "project": ("SITUACAO_PROJETO_BASICO", 10),
}

BALANCE_SQL = (
    "SELECT {g}, count(TARGET) AS total, count_if(TARGET = 0) AS negativos, count_if(TARGET = 1) AS positivos "
    "FROM {table} GROUP BY {g} ORDER BY total DESC"
)


def class_balance_report(features: DataFrame, report: str, top: bool = False) -> DataFrame:
    g, n = BALANCE_REPORTS[report]
    out = rel.class_balance(features, g, "TARGET")
    return rel.top_groups(out, g, n) if top else out


def run_sql_report(spark: SparkSession, features: DataFrame, report: str,
                   view: str = "features") -> DataFrame:
    """A report written as a SQL string, run by Spark SQL."""
    g, _ = BALANCE_REPORTS[report]
    features.createOrReplaceTempView(view)
    return spark.sql(BALANCE_SQL.format(g=g, table=view))


def value_histogram(features: DataFrame, n_bins: int = 1000, view_max: float = 5_000_000.0,
                    value: str = "VL_GLOBAL_CONV", label: str = "TARGET") -> DataFrame:
    """Per-class equal-width histogram of the global value, bins in view."""
    h = mx.class_histogram(features.filter(features[label].isin(0, 1)), value, label, n_bins)
    return h.filter(h["lo"] <= view_max)


def run_reports(features: DataFrame, predictions: DataFrame | None = None) -> dict[str, DataFrame]:
    """All report tables: four class-balance reports (full and top rows), the
    value histogram and, given predictions, the probability distribution,
    metric table and curves."""
    out = {}
    for name in BALANCE_REPORTS:
        out[f"balance_{name}"] = class_balance_report(features, name)
        out[f"top_{name}"] = class_balance_report(features, name, top=True)
    out["hist_value"] = value_histogram(features)
    if predictions is not None:
        h = mx.class_histogram(predictions, "probability", "label", 50)
        out["hist_probability"] = mx.cumulative_histogram(h, "label")
        out["metrics"] = mx.metric_pivot(mx.metric_long(predictions))
        out["roc_points"] = mx.roc_points(predictions, group="classifier")
        out["pr_points"] = mx.pr_points(predictions, group="classifier")
        out["misclassified"] = mx.misclassified(predictions)
    return out
