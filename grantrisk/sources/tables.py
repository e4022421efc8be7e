"""Tables and models on shared storage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from grantrisk.functions import scalar as fx


def append_table(df: DataFrame, path: str) -> None:
    """Append rows (re-running appends again, like any append load)."""
    df.write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Replace a table."""
    w = df.write.mode("overwrite")
    cols = list(partition_by)
    if cols:
        w = w.partitionBy(*cols)
    w.parquet(path)


def read_table(spark: SparkSession, path: str, parse_dates: dict[str, str] | None = None) -> DataFrame:
    """Full scan (columns/filters pruned by Catalyst) + optional date parsing."""
    df = spark.read.parquet(path)
    if parse_dates:
        df = df.withColumns({c: fx.parse_date(c, fmt) for c, fmt in parse_dates.items()})
    return df


def stage(df: DataFrame, path: str) -> DataFrame:
    """Materialise a stage table and continue from the written copy."""
    write_table(df, path)
    return df.sparkSession.read.parquet(path)


def save_named(df: DataFrame, root: str, name: str, **tags: str) -> str:
    """Persist an intermediate data set under ``root/name/k=v...``."""
    parts = [name] + [f"{k}={v}" for k, v in sorted(tags.items())]
    path = root.rstrip("/") + "/" + "/".join(parts)
    write_table(df, path)
    return path


def load_named(spark: SparkSession, root: str, name: str, **tags: str) -> DataFrame:
    parts = [name] + [f"{k}={v}" for k, v in sorted(tags.items())]
    return spark.read.parquet(root.rstrip("/") + "/" + "/".join(parts))


def save_model(model, path: str) -> None:
    """Spark ML writer (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str, cls=PipelineModel):
    return cls.load(path)


def write_bucketed(df: DataFrame, table: str, key: str, n_buckets: int, path: str) -> DataFrame:
    """Stage ``df`` as a catalog table bucketed and sorted by ``key``.

    Tables bucketed on the same key with the same bucket count join and
    aggregate on that key without a shuffle (co-located), which is what
    repeated feature-table builds over the same extracts want.  Data files
    live at ``path`` (shared storage); only the table definition is in the
    session catalog.  Rows go to the task of their bucket first: a file per
    bucket, however many tasks ``df`` has, and no task idle where the files
    that it is read from have few row groups.
    """
    df.repartition(n_buckets, key).write.mode("overwrite").bucketBy(n_buckets, key).sortBy(key) \
        .option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
