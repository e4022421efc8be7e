"""ETL: source extracts -> labelled feature table (one lazy DAG).

Stages mirror the staged tables of the original load: agreements cut to 14
columns and five final statuses, the proposal columns and label, amendment
and consortium-member counts, then the feature maths.  All joins are on the
proposal id, so Spark hash-partitions each side once on that key and the
chain of left joins reuses the partitioning.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantrisk import schemas
from grantrisk.functions import scalar as fx
from grantrisk.operators import relational as rel

KEY = "ID_PROPOSTA"


def agreements(convenio: DataFrame) -> DataFrame:
    """P5 + P1: final statuses only, 14 columns."""
    return rel.project(rel.keep_values(convenio, "SIT_CONVENIO", schemas.FINAL_STATUSES),
                       schemas.AGREEMENT_COLUMNS)


def with_proposal(agr: DataFrame, proposta: DataFrame) -> DataFrame:
    """J1 + P7: proposal columns (NULL when unmatched) and the label."""
    j = rel.left_join_columns(agr, proposta, KEY, schemas.PROPOSAL_COLUMNS)
    return rel.with_label(j, "SIT_CONVENIO", "TARGET")


def with_amendments(df: DataFrame, emenda: DataFrame, compat: bool = False) -> DataFrame:
    """EMENDAS per agreement."""
    if compat:
        return rel.count_matches_grouped(df, emenda, KEY, "NR_CONVENIO", "EMENDAS")
    return rel.count_matches(df, emenda, KEY, "EMENDAS")


def with_participants(df: DataFrame, consorcios: DataFrame, compat: bool = False) -> DataFrame:
    """CNPJS_CONSORCIOS per agreement (distinct members, or compat pick)."""
    if compat:
        return rel.participants_compat(df, consorcios, KEY, "CNPJ_PARTICIPANTE", "CNPJS_CONSORCIOS")
    return rel.participants_distinct(df, consorcios, KEY, "CNPJ_PARTICIPANTE", "CNPJS_CONSORCIOS")


def staged(convenio: DataFrame, proposta: DataFrame, emenda: DataFrame,
           consorcios: DataFrame, compat: bool = False) -> DataFrame:
    """The four staged tables as one plan (before feature maths)."""
    df = with_proposal(agreements(convenio), proposta)
    df = with_amendments(df, emenda, compat)
    return with_participants(df, consorcios, compat)


def feature_maths(df: DataFrame) -> DataFrame:
    """F1, F2, F3, F4, F5 and the date drop."""
    types = dict(df.dtypes)
    df = df.withColumns({c: fx.fill_zero_expr(c, types[c]) for c in schemas.ZERO_FILL_COLUMNS})
    df = df.withColumn("SITUACAO_PROJETO_BASICO", fx.fill_missing_expr("SITUACAO_PROJETO_BASICO"))
    df = df.withColumns({
        "PERC_REPASSE": fx.share("VL_REPASSE_CONV", "VL_GLOBAL_CONV"),
        "PERC_CONTRA": fx.share("VL_CONTRAPARTIDA_CONV", "VL_GLOBAL_CONV"),
        "PERC_DESEMBOLSADO": fx.share("VL_DESEMBOLSADO_CONV", "VL_GLOBAL_CONV"),
    })
    start = fx.parse_date("DIA_INIC_VIGENC_CONV")
    df = df.withColumns({
        "DIF_ORIG": fx.day_diff(fx.parse_date("DIA_FIM_VIGENC_ORIGINAL_CONV"), start),
        "DIF_PRORROG": fx.day_diff(fx.parse_date("DIA_FIM_VIGENC_CONV"), start),
    })
    return df.drop(*schemas.DATE_COLUMNS)


def feature_table(convenio: DataFrame, proposta: DataFrame, emenda: DataFrame,
                  consorcios: DataFrame, compat: bool = False) -> DataFrame:
    """Labelled feature table (one row per agreement when ids are unique)."""
    return feature_maths(staged(convenio, proposta, emenda, consorcios, compat))


def model_input(features: DataFrame) -> DataFrame:
    """F7 + casts of the model-input table: value band, MES as category.

    Ids are kept (``NR_CONVENIO`` as row id, ``TARGET`` as label) so that the
    label always travels in the same row as its features.
    """
    df = features.withColumn("FAIXA_VALOR", fx.value_band("VL_GLOBAL_CONV"))
    df = df.withColumn("FAIXA_VALOR", fx.fill_missing_expr("FAIXA_VALOR"))
    df = df.withColumn("MES", F.col("MES").cast("string"))
    num = {c: F.col(c).cast("double") for c in schemas.NUMERIC_FEATURES}
    df = df.withColumns(num)
    keep = ["NR_CONVENIO", "TARGET"] + schemas.NUMERIC_FEATURES + schemas.CATEGORICAL_FEATURES
    return df.select(*keep)


def stage_sources_bucketed(tables: dict[str, DataFrame], root: str, n_buckets: int,
                           prefix: str = "stage") -> dict[str, DataFrame]:
    """Stage the four loaded sources bucketed by the proposal id.

    Every join and grouping of :func:`feature_table` is on that key, so the
    feature build then runs without any shuffle of the staged inputs.  The
    sources are staged side by side.
    """
    from grantrisk.sources.tables import write_bucketed
    with ThreadPoolExecutor(max_workers=max(1, len(tables))) as ex:
        staging = {t: ex.submit(write_bucketed, df, f"{prefix}_{t}", KEY, n_buckets, f"{root.rstrip('/')}/{t}") for t, df in tables.items()}
    return {t: done.result() for t, done in staging.items()}


def run_etl(spark, extracts: str, out: str, export_csv: str | None = None,
            bucket_root: str | None = None, n_buckets: int = 0, compat: bool = False,
            allow_missing: bool = False) -> DataFrame:
    """Extract folder -> typed sources -> (optional bucketed stage) -> feature
    table written to ``out`` (and optionally exported as ``;`` CSV)."""
    from grantrisk.sources import tables as tbl
    from grantrisk.sources import text as txt
    src = txt.load_tables(spark, extracts, allow_missing=allow_missing)
    if bucket_root and n_buckets > 0:
        src = stage_sources_bucketed(src, bucket_root, n_buckets)
    feats = feature_table(src["convenio"], src["proposta"], src["emenda"], src["consorcios"], compat)
    tbl.write_table(feats, out)
    written = spark.read.parquet(out)
    if export_csv:
        txt.export_csv(written, export_csv)
    return written
