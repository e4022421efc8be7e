"""Binding of the driver's benchmark tables to the agreement data model.

The reference's four loaded extracts are derived from the benchmark tables
by portable SQL (runs unchanged in Spark SQL and DuckDB), so a Spark query
and its DuckDB oracle start from identical inputs:

* agreements (``convenio``)    <- ``orders`` (one agreement per order)
* proposals  (``proposta``)    <- ``orders`` x ``customer`` x ``nation``,
  customers with a negative balance have no proposal (unmatched agreements)
* amendments (``emenda``)      <- ``lineitem`` rows
* consortium members (``consorcios``) <- ``lineitem`` (order, supplier)
* predictions / matrices       <- ``orders``, ``labels``, ``embeddings``

Table names in the templates are ``{name}``; Spark fills them with views
private to one data folder, DuckDB with the pre-registered view names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from grantrisk import schemas

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]


def _ddmmyyyy(expr: str) -> str:
    return (f"lpad(CAST(day({expr}) AS STRING), 2, '0') || '/' || "
            f"lpad(CAST(month({expr}) AS STRING), 2, '0') || '/' || CAST(year({expr}) AS STRING)")


_neg, _pos = schemas.STATUS_NEGATIVE, schemas.STATUS_POSITIVE

CONVENIO_SQL = f"""
SELECT CAST(o_orderkey AS STRING) AS NR_CONVENIO,
       CAST(o_orderkey AS STRING) AS ID_PROPOSTA,
       CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN '{_neg[1]}'
            WHEN o_orderstatus = 'F' THEN '{_neg[0]}'
            WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN '{_pos[1]}'
            WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN '{_pos[2]}'
            WHEN o_orderstatus = 'O' THEN '{_pos[0]}'
            ELSE 'Em execução' END AS SIT_CONVENIO,
       CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS QTD_TA,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN CAST(NULL AS INTEGER)
            ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS QTD_PRORROGA,
       CAST(month(o_orderdate) AS INTEGER) AS MES,
       CAST(1 AS INTEGER) AS QTDE_CONVENIOS,
       o_totalprice AS VL_GLOBAL_CONV,
       o_totalprice * 0.8 AS VL_REPASSE_CONV,
       o_totalprice * 0.2 AS VL_CONTRAPARTIDA_CONV,
       CASE WHEN o_orderpriority = '5-LOW' THEN CAST(NULL AS DOUBLE)
            ELSE o_totalprice * CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) / 5.0 END
           AS VL_DESEMBOLSADO_CONV,
       {_ddmmyyyy('o_orderdate')} AS DIA_INIC_VIGENC_CONV,
       CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O'
            THEN '31/02/' || CAST(year(o_orderdate) AS STRING)
            ELSE {_ddmmyyyy('CAST(o_orderdate AS DATE) + CAST(o_custkey % 700 - 100 AS INTEGER)')}
            END AS DIA_FIM_VIGENC_CONV,
       {_ddmmyyyy('CAST(o_orderdate AS DATE) + CAST(o_custkey % 500 - 100 AS INTEGER)')}
           AS DIA_FIM_VIGENC_ORIGINAL_CONV
FROM {{orders}}
"""

PROPOSTA_SQL = """
SELECT CAST(o.o_orderkey AS STRING) AS ID_PROPOSTA,
       n.n_name AS UF_PROPONENTE,
       CAST(c.c_custkey AS STRING) AS COD_MUNIC_IBGE,
       CAST(n.n_regionkey AS STRING) AS COD_ORGAO_SUP,
       CAST(n.n_nationkey AS STRING) AS COD_ORGAO,
       o.o_orderpriority AS MODALIDADE,
       c.c_name AS IDENTIF_PROPONENTE,
       c.c_mktsegment AS SITUACAO_CONTA,
       CASE WHEN c.c_acctbal < 1000 THEN CAST(NULL AS STRING)
            WHEN c.c_acctbal < 5000 THEN 'Em análise' ELSE 'Aceito' END AS SITUACAO_PROJETO_BASICO
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
WHERE c.c_acctbal >= 0
"""

EMENDA_SQL = """
SELECT CAST(l_orderkey AS STRING) AS ID_PROPOSTA,
       CAST(l_linenumber AS STRING) AS NR_EMENDA,
       l_extendedprice AS VALOR_REPASSE_EMENDA
FROM {lineitem}
"""

CONSORCIOS_SQL = """
SELECT CAST(l_orderkey AS STRING) AS ID_PROPOSTA,
       CAST(l_partkey AS STRING) AS CNPJ_CONSORCIO,
       CAST(l_suppkey AS STRING) AS CNPJ_PARTICIPANTE
FROM {lineitem}
"""

# Scored predictions: three score rules over finished/open orders.
PREDICTIONS_SQL = """
SELECT o_orderkey AS row_id, rule AS classifier,
       CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS label,
       score AS probability,
       CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction
FROM (
  SELECT o_orderkey, o_orderstatus, 'rule7' AS rule,
         floor((o_totalprice * 7) % 1000) / 1000.0 AS score FROM {orders} WHERE o_orderstatus IN ('F', 'O')
  UNION ALL
  SELECT o_orderkey, o_orderstatus, 'rule13' AS rule,
         floor((o_totalprice * 13) % 1000) / 1000.0 AS score FROM {orders} WHERE o_orderstatus IN ('F', 'O')
  UNION ALL
  SELECT o_orderkey, o_orderstatus, 'rule_month' AS rule,
         CAST(month(o_orderdate) AS DOUBLE) / 12.0 AS score FROM {orders} WHERE o_orderstatus IN ('F', 'O')
) s
"""

# Binary label per document (toxic) for split / fold / weight operators.
LABELLED_ROWS_SQL = """
SELECT doc_id AS row_id, CAST(toxic AS INTEGER) AS label, CAST(quality AS INTEGER) AS quality
FROM {labels}
"""

# Numeric matrix: 64-float embeddings; minority (positive) class = label 0.
MATRIX_SQL = """
SELECT vec_id AS row_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, embedding
FROM {embeddings}
"""

BINDINGS = {
    "convenio": CONVENIO_SQL,
    "proposta": PROPOSTA_SQL,
    "emenda": EMENDA_SQL,
    "consorcios": CONSORCIOS_SQL,
    "predictions": PREDICTIONS_SQL,
    "labelled": LABELLED_ROWS_SQL,
    "matrix": MATRIX_SQL,
}


def duckdb_sql(name: str) -> str:
    """Binding text with the driver's DuckDB view names."""
    return BINDINGS[name].format(**{t: t for t in BASE_TABLES})


def _view_prefix(sf_dir: str) -> str:
    return "gr_" + re.sub(r"[^0-9a-zA-Z]+", "_", sf_dir.strip("/")) + "_"


def _view(spark: SparkSession, sf_dir: str, t: str) -> str:
    view = _view_prefix(sf_dir) + t
    if not spark.catalog.tableExists(view):
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet").createOrReplaceTempView(view)
    return view


def register_base(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> dict[str, str]:
    """Temp views over the parquet files of one folder; returns name -> view."""
    return {t: _view(spark, sf_dir, t) for t in names}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a bound reference table as a DataFrame (only the base
    tables the binding reads are registered)."""
    if name in BASE_TABLES:
        return spark.table(_view(spark, sf_dir, name))
    used = [t for t in BASE_TABLES if "{" + t + "}" in BINDINGS[name]]
    names = register_base(spark, sf_dir, used)
    return spark.sql(BINDINGS[name].format(**names))
