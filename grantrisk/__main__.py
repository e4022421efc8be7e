"""Command line: ``python -m grantrisk <etl|report|train> ...`` (spark-submit friendly).

* ``etl --extracts DIR --out PATH [--csv PATH] [--bucket-root DIR --buckets N]``
* ``report --features PATH --out DIR``
* ``train --features PATH --out DIR [--variants ...] [--tune-iter N] [--resample smote:0.2 ...]``

Outputs are parquet tables (one folder per table) on shared storage.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="grantrisk")
    sub = ap.add_subparsers(dest="cmd", required=True)
    e = sub.add_parser("etl")
    e.add_argument("--extracts", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--csv")
    e.add_argument("--bucket-root")
    e.add_argument("--buckets", type=int, default=0)
    e.add_argument("--compat", action="store_true")
    e.add_argument("--allow-missing", action="store_true", help="columns that the extracts lack become NULL")
    r = sub.add_parser("report")
    r.add_argument("--features", required=True)
    r.add_argument("--predictions")
    r.add_argument("--out", required=True)
    t = sub.add_parser("train")
    t.add_argument("--features", required=True)
    t.add_argument("--out", required=True)
    t.add_argument("--variants", nargs="*", default=["all", "sem_municipio", "sem_municipio_orgao"])
    t.add_argument("--models", nargs="*", default=["gbt", "logit", "mlp"])
    t.add_argument("--tune-iter", type=int, default=0)
    t.add_argument("--tune-folds", type=int, default=10)
    t.add_argument("--resample", nargs="*", default=[])
    a = ap.parse_args(argv)

    own = SparkSession.getActiveSession() is None
    spark = SparkSession.builder.appName(f"grantrisk-{a.cmd}").getOrCreate()
    from grantrisk.session import checkpoint_root, release_scratch
    from grantrisk.sources import tables as tbl
    checkpoint_root(spark)
    if a.cmd == "etl":
        from grantrisk.plans import etl
        etl.run_etl(spark, a.extracts, a.out, a.csv, a.bucket_root, a.buckets, a.compat, a.allow_missing)
    elif a.cmd == "report":
        from grantrisk.plans import report
        preds = spark.read.parquet(a.predictions) if a.predictions else None
        for name, df in report.run_reports(spark.read.parquet(a.features), preds).items():
            tbl.write_table(df, f"{a.out.rstrip('/')}/{name}")
    else:
        from grantrisk.plans import train
        res = [(m, float(x)) for m, x in (s.split(":") for s in a.resample)]
        out = train.experiment(spark.read.parquet(a.features), variants=tuple(a.variants),
                               models=tuple(a.models), resample=res, tune_iter=a.tune_iter,
                               tune_folds=a.tune_folds)
        tbl.write_table(out, f"{a.out.rstrip('/')}/metrics")
    if own:  # a caller's session may still need its scratch tables
        release_scratch(spark)


if __name__ == "__main__":
    main()
