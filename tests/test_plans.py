"""Plan guards: no cartesian / nested-loop joins and no Python UDFs."""

import pytest

from grantrisk.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["feature_table", "feature_table_bucketed", "roc_auc", "holdout_split",
                                  "stratified_folds", "smote", "nearmiss", "first_seen_codes", "hist_value",
                                  "class_weights", "shuffle_order"])
def test_plan_shape(spark, name):
    df = QUERIES[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


def test_a_bucket_is_one_file_however_many_tasks_write(spark, tmp_path):
    from grantrisk.sources.tables import write_bucketed
    df = spark.range(400).selectExpr("IF(id % 10 = 0, NULL, CAST(id % 90 AS STRING)) AS k", "id").repartition(6)
    back = write_bucketed(df, "one_file_a_bucket", "k", 4, str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("part-*.parquet"))) <= 4
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert "Exchange" not in back.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
