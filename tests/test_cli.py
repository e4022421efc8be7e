from grantrisk.__main__ import main
from grantrisk.plans import queries as Q
from grantrisk.session import scratch_path
from grantrisk.sources import text as txt

SF = "/root/testdata/sf0.001"


def test_cli_etl_and_report(spark):
    root = scratch_path(spark, "t_cli")
    for t in Q.BOUND_SOURCES:
        txt.export_csv(Q._t(spark, SF, t), txt.extract_path(f"{root}/extracts", t))
    main(["etl", "--extracts", f"{root}/extracts", "--out", f"{root}/features", "--csv", f"{root}/features_csv",
          "--bucket-root", f"{root}/stage", "--buckets", "4", "--allow-missing"])
    feats = spark.read.parquet(f"{root}/features")
    assert feats.count() == Q.QUERIES["feature_table"](spark, SF).count()
    main(["report", "--features", f"{root}/features", "--out", f"{root}/reports"])
    assert spark.read.parquet(f"{root}/reports/top_project").count() <= 10
    assert spark.read.parquet(f"{root}/reports/hist_value").count() == 2000
