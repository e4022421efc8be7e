"""Session helpers.

The library never creates machine-local scratch space on a cluster: every
intermediate that must survive executor loss is written below the shared
folder named by ``spark.checkpoint.dir``.  Only when that setting is absent
(unit tests, a laptop) is a private temporary folder created and registered.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
}


def local_session(cores: int | str = "*", app: str = "grantrisk") -> SparkSession:
    """A local session for tests and the bench (never used by library code)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in _LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and staged tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir); set a private one only when neither is configured.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = sc.getCheckpointDir()
        if current:
            return current
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors "
                               "(a machine-local temporary folder does not survive executor loss)")
        root = tempfile.mkdtemp(prefix="grantrisk-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/grantrisk/{spark.sparkContext.applicationId}"


def release_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, for the end of a job: no result may still be lazy."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, eager: bool = True, schema: StructType | None = None, options: dict | None = None) -> DataFrame:
    """``df`` computed once, as a Parquet table below the shared checkpoint folder: survives executor loss.

    Later passes read only the columns and row groups that they need; a
    checkpoint's rows are Java objects, which each pass reads whole.  Tables
    that Parquet cannot hold (untyped NULLs, names that occur twice) and lazy
    cuts are checkpointed, never ``localCheckpoint``.  ``schema``: as which the
    table is read, if not as ``df``; ``options``: of the writer.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    names = {c.lower() for c in df.columns}
    if not eager or len(names) < len(df.columns) or not names or "void" in df.schema.simpleString():
        return df.checkpoint(eager=eager)
    path = scratch_path(spark, "cut")
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def cluster_conf(total_input_bytes: int, cores: int, target_partition_bytes: int = 256 * 1024 * 1024) -> dict:
    """Submission settings sized for a large cluster (apply at job submit).

    * input splits of ``target_partition_bytes`` (parquet/CSV are splittable),
    * initial shuffle partitions ~ input / target, at least 3 waves of cores,
      then AQE coalesces small ones and splits skewed ones at runtime,
    * broadcast only what AQE measured below a fixed threshold.
    The library never sets these itself on a shared cluster.
    """
    parts = max(3 * cores, total_input_bytes // target_partition_bytes)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(int(parts)),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.sources.bucketing.enabled": "true",
    }
