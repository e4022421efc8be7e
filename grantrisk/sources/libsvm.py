"""Labelled sparse rows in libsvm text.

Spark's ``libsvm`` source expects 1-based indices.  Files written by tools
that use 0-based indices are read with ``zero_based=True``: indices are
shifted by one with built-in string functions into a staging folder below
the shared checkpoint folder, then read by the ``libsvm`` source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantrisk.operators.prepare import vector_entries
from grantrisk.session import scratch_path


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features",
                 zero_based: bool = False) -> None:
    """One line per row, ``label idx:value ...`` (non-zeros only)."""
    if not zero_based:
        df.select(F.col(label).cast("double").alias("label"), F.col(features).alias("features")) \
            .write.mode("overwrite").format("libsvm").save(path)
        return
    toks = F.transform("entries", lambda p: F.concat(p["idx"].cast("string"), F.lit(":"), p["value"].cast("string")))
    line = F.concat_ws(" ", F.col(label).cast("double").cast("string"), F.concat_ws(" ", toks))
    vector_entries(df, features).select(line.alias("value")).write.mode("overwrite").text(path)


def read_libsvm(spark: SparkSession, path: str, n_features: int, zero_based: bool = False) -> DataFrame:
    """(label, features) with a fixed vector width."""
    src = path
    if zero_based:
        src = scratch_path(spark, "libsvm1")
        toks = F.split(F.trim(F.col("value")), " +")
        shifted = F.transform(F.slice(toks, 2, 1 << 30), lambda t: F.concat(
            (F.split(t, ":")[0].cast("int") + 1).cast("string"), F.lit(":"), F.split(t, ":")[1]))
        spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(
            F.concat_ws(" ", toks[0], F.concat_ws(" ", shifted)).alias("value")) \
            .write.mode("overwrite").text(src)
    return spark.read.format("libsvm").option("numFeatures", str(n_features)).load(src)
