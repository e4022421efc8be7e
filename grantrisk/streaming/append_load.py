"""Exactly-once append load of semicolon extracts (S4/S5 as a file stream)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from grantrisk import schemas
from grantrisk.operators import relational as rel
from grantrisk.sources.text import CSV_OPTIONS, cast_columns, read_text_table


def header_schema(spark: SparkSession, folder: str, pattern: str) -> T.StructType:
    """Text schema in the files' own header order (one header row is read)."""
    cols = read_text_table(spark, f"{folder.rstrip('/')}/{pattern}").columns
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


def stream_extracts(spark: SparkSession, folder: str, table: str, dst: str, checkpoint: str,
                    filter_status: bool = True, max_files_per_trigger: int | None = None,
                    pattern: str = "*.csv", allow_missing: bool = False) -> int:
    """Append every not-yet-loaded extract file (``pattern``) of ``folder``,
    typed as ``table``, to the parquet table ``dst``; returns the number of
    micro-batches run.  A file whose header differs from the others' (other
    names or another order) is an error, never loaded by position."""
    sp = schemas.spec(table)
    reader = spark.readStream.options(**CSV_OPTIONS).schema(header_schema(spark, folder, pattern)) \
        .option("pathGlobFilter", pattern).option("multiLine", "true").option("enforceSchema", "false")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.csv(folder)
    typed = cast_columns(raw, {c: sp.type_of(c) for c in sp.columns}, allow_missing).select(*sp.columns)
    if table == "convenio" and filter_status:
        typed = rel.keep_values(typed, "SIT_CONVENIO", schemas.FINAL_STATUSES)
    q = typed.writeStream.format("parquet").option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True).start(dst)
    q.awaitTermination()
    return len(q.recentProgress)
