from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from grantrisk.session import cut_lineage


def test_a_cut_is_a_table_that_later_passes_read_by_columns(spark):
    df = spark.createDataFrame([(1, "é", Vectors.sparse(3, {1: 2.0})), (2, None, Vectors.dense([1.0, 0.0, 3.0]))], ["id", "a b", "v"])
    df = df.withColumn("id", F.col("id").alias("id", metadata={"kept": 1}))
    cut = cut_lineage(df)
    assert cut.inputFiles() and all(f.endswith(".parquet") for f in cut.inputFiles())
    assert cut.schema["id"].metadata == {"kept": 1} and cut.columns == df.columns
    assert sorted(cut.collect()) == sorted(df.collect())
    assert cut_lineage(df.where("id > 5")).count() == 0


def test_what_parquet_cannot_hold_is_cut_too(spark):
    df = spark.createDataFrame([(1,)], "id long")
    assert cut_lineage(df.withColumn("nothing", F.lit(None))).collect() == [(1, None)]
    assert cut_lineage(df.select("id", (F.col("id") + 1).alias("id"))).collect() == [(1, 2)]
