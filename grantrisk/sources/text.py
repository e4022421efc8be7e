"""Semicolon-separated extracts.

Extracts are read as text by header name and cast by name with the
registry in :mod:`grantrisk.schemas`; numbers use a decimal comma.  A quoted
field may hold line breaks; files larger than one split are read by
:mod:`grantrisk.sources.quoted`, which finds out in which splits a line break
ends a record.  ``multi_line=False`` saves that pass for files known to have
no line breaks in fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantrisk import schemas
from grantrisk.functions import scalar as fx
from grantrisk.operators import relational as rel
from grantrisk.sources import quoted

CSV_OPTIONS = {"sep": ";", "header": "true", "encoding": "UTF-8", "quote": '"', "escape": '"'}


def split_size(spark: SparkSession) -> int:
    """``spark.sql.files.maxPartitionBytes`` as a number."""
    text = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1:], 0)
    return int(text[:-1] if unit else text) << unit


def _largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file of a path (lengths only, no content is read)."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length").alias("n")).first()["n"] or 0


def read_text_table(spark: SparkSession, path: str, multi_line: bool = True, split_bytes: int | None = None) -> DataFrame:
    """All columns as strings, named by the header.

    With ``multi_line``, files of more than ``split_bytes`` (default: the
    session's split size) are read by many tasks, smaller ones by one each.
    Large files without a quote are read line by line, by Spark alone.
    """
    if multi_line:
        limit = split_bytes if split_bytes is not None else split_size(spark)
        if _largest_file(spark, path) > limit:
            if not quoted.lines_are_records(spark, path):
                return quoted.read_text_table(spark, path, CSV_OPTIONS)
            return spark.read.options(**CSV_OPTIONS, lineSep="\n").option("inferSchema", "false").csv(path)
    return spark.read.options(**CSV_OPTIONS).option("multiLine", str(multi_line).lower()) \
        .option("inferSchema", "false").csv(path)


def cast_columns(df: DataFrame, types: dict[str, T.DataType], allow_missing: bool = False, rejects: str | None = None) -> DataFrame:
    """Text -> declared types; doubles accept a decimal comma; bad text -> NULL.

    A declared column that the text lacks is an error, or NULL with
    ``allow_missing``.  With ``rejects`` a column of that name lists the bad
    texts of a row as (column, text), so that none becomes NULL unseen; blank
    text is no value and no reject.
    """
    missing = [c for c in types if c not in df.columns]
    if missing and not allow_missing:
        raise ValueError(f"columns missing from the text: {missing}")
    df = df.withColumns({c: F.lit(None).cast("string") for c in missing})
    out = {}
    for c, t in types.items():
        if isinstance(t, T.StringType):
            continue
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            out[c] = fx.decimal_comma_to_double(c).cast(t)
        elif isinstance(t, T.BooleanType):
            out[c] = F.lower(F.trim(F.col(c))).isin("true", "1")
        else:
            out[c] = F.trim(F.col(c)).try_cast(t)
    if rejects:
        bad = [F.when((F.trim(F.col(c)) != "") & typed.isNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("text")))
               for c, typed in out.items()]
        empty = F.array().cast("array<struct<column: string, text: string>>")
        out[rejects] = F.filter(F.array(*bad), lambda r: r.isNotNull()) if bad else empty
    return df.withColumns(out) if out else df


def reject_table(df: DataFrame, keys: Sequence[str] = (), rejects: str = "rejects") -> DataFrame:
    """(keys, column, text): a row per text that ``cast_columns`` could not cast."""
    return df.select(*keys, F.inline(rejects))


def count_rejects(df: DataFrame, columns: Sequence[str], rejects: str = "rejects") -> DataFrame:
    """One row: ``rows`` and, per column, the number of its bad texts.

    An aggregate, not an ``Observation``: a session that has observed a query
    can no longer serialize logistic models (their summaries hold the session).
    """
    names = F.transform(rejects, lambda r: r["column"])
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.array_contains(names, c)).alias(c) for c in columns])


def read_extract(spark: SparkSession, path: str, table: str, multi_line: bool = True,
                 allow_missing: bool = False, rejects: str | None = None) -> DataFrame:
    """One source extract with the registry's types and column order, and its bad texts in ``rejects`` (see ``cast_columns``)."""
    sp = schemas.spec(table)
    raw = read_text_table(spark, path, multi_line)
    typed = cast_columns(raw, {c: sp.type_of(c) for c in sp.columns}, allow_missing, rejects)
    return typed.select(*sp.columns, *([rejects] if rejects else []))


def extract_path(folder: str, table: str) -> str:
    return f"{folder.rstrip('/')}/{schemas.FILE_PREFIX}{table}.csv"


def load_tables(spark: SparkSession, folder: str, tables: Sequence[str] = schemas.LOADED_TABLES,
                filter_status: bool = True, multi_line: bool = True,
                allow_missing: bool = False) -> dict[str, DataFrame]:
    """The loaded extracts; agreements keep only final statuses (P5)."""
    out = {}
    for t in tables:
        df = read_extract(spark, extract_path(folder, t), t, multi_line, allow_missing)
        if t == "convenio" and filter_status:
            df = rel.keep_values(df, "SIT_CONVENIO", schemas.FINAL_STATUSES)
        out[t] = df
    return out


def to_text_columns(df: DataFrame) -> DataFrame:
    """Render every column as extract text (decimal comma for floating values)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(F.translate(F.col(f.name).cast("string"), ".", ",").alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(fx.double_to_decimal_comma(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name).cast("string").alias(f.name))
    return df.select(*cols)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``;`` separated, header, decimal comma, no index column."""
    to_text_columns(df).write.mode(mode).options(**CSV_OPTIONS).csv(path)


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read an export back with a known schema (S1 applied to S10 output)."""
    raw = read_text_table(spark, path)
    typed = cast_columns(raw, {f.name: f.dataType for f in schema.fields})
    return typed.select(*[f.name for f in schema.fields])


def repair_file(spark: SparkSession, src: str, dst: str) -> None:
    """S3: separator repair line by line into a *new* path (input untouched).

    The two patterns cannot cross a line break, so line-wise rewriting equals
    rewriting the whole file as one string.
    """
    lines = spark.read.text(src)
    lines.select(fx.repair_separators("value").alias("value")).write.mode("overwrite").text(dst)


def repair_report(spark: SparkSession, src: str) -> DataFrame:
    """Lines whose separator count changes under the repair (fields merged)."""
    lines = spark.read.text(src)
    n_before = F.size(F.split("value", ";")) - 1
    n_after = F.size(F.split(fx.repair_separators("value"), ";")) - 1
    return lines.select("value", n_before.alias("seps_before"), n_after.alias("seps_after")) \
        .filter(F.col("seps_before") != F.col("seps_after"))
