"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed completely with a ``noop`` write (every row is
produced, nothing is collected to the driver).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "feature_table", "feature_table_compat", "feature_table_bucketed", "etl_from_files", "csv_roundtrip",
    "class_balance_agency", "top_groups_project", "hist_value", "distinct_categories",
    "roc_auc", "avg_precision", "pr_points", "metric_pivot", "hist_proba_cumulative",
    "first_seen_codes", "onehot_wide", "standardize",
    "holdout_split", "stratified_folds", "shuffle_order", "smote", "nearmiss", "smote_nearmiss",
    "logit", "gbt",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [a for a in sys.argv[1:]] or HEADLINE
    from grantrisk.plans.queries import QUERIES
    from grantrisk.session import local_session, release_scratch
    spark = local_session(cpus, app="grantrisk-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up, not timed
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        t0 = time.time()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    release_scratch(spark)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": int(cpus)}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
