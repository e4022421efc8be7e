"""DuckDB oracle SQL, one statement per registered query.

Each statement starts from the same binding SQL as the Spark side
(:mod:`grantrisk.sources.testdata`) and re-states the operator in plain SQL,
written independently of the DataFrame code.  Floating outputs are rounded
to 6 places, as on the Spark side.
"""

from __future__ import annotations

from grantrisk import schemas
from grantrisk.plans import report
from grantrisk.sources import testdata as td

ORACLE: dict[str, str] = {}


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


_FINAL = ", ".join(_q(s) for s in schemas.FINAL_STATUSES)
_NEG = schemas.STATUS_NEGATIVE
_POS = schemas.STATUS_POSITIVE
_LABEL_CASE = ("CASE {c} " + " ".join(f"WHEN {_q(s)} THEN 0" for s in _NEG) + " "
               + " ".join(f"WHEN {_q(s)} THEN 1" for s in _POS) + " END")
_AGR = ", ".join(schemas.AGREEMENT_COLUMNS)
_PROP = ", ".join(f"p.{c}" for c in schemas.PROPOSAL_COLUMNS)
_DMY = "'%d/%m/%Y'"


def _date(c: str) -> str:
    return f"CAST(try_strptime({c}, {_DMY}) AS DATE)"


BINDING_CTES = ",\n".join(f"{name} AS ({td.duckdb_sql(name)})" for name in td.BINDINGS)

FEATURE_CTES = f"""
agr AS (SELECT {_AGR} FROM convenio WHERE SIT_CONVENIO IN ({_FINAL})),
cp AS (SELECT a.*, {_PROP}, {_LABEL_CASE.format(c='a.SIT_CONVENIO')} AS TARGET
       FROM agr a LEFT JOIN proposta p ON a.ID_PROPOSTA = p.ID_PROPOSTA),
em AS (SELECT ID_PROPOSTA, count(*) AS n FROM emenda WHERE ID_PROPOSTA IS NOT NULL GROUP BY ID_PROPOSTA),
cs AS (SELECT ID_PROPOSTA, count(DISTINCT CNPJ_PARTICIPANTE) AS n FROM consorcios
       WHERE ID_PROPOSTA IS NOT NULL AND CNPJ_PARTICIPANTE IS NOT NULL GROUP BY ID_PROPOSTA),
stg AS (SELECT cp.*, CAST(coalesce(em.n, 0) AS BIGINT) AS EMENDAS,
               CAST(coalesce(cs.n, 0) AS BIGINT) AS CNPJS_CONSORCIOS
        FROM cp LEFT JOIN em ON cp.ID_PROPOSTA = em.ID_PROPOSTA
                LEFT JOIN cs ON cp.ID_PROPOSTA = cs.ID_PROPOSTA),
filled AS (SELECT * REPLACE (
              coalesce(QTD_TA, 0) AS QTD_TA, coalesce(QTD_PRORROGA, 0) AS QTD_PRORROGA,
              coalesce(QTDE_CONVENIOS, 0) AS QTDE_CONVENIOS, coalesce(MES, 0) AS MES,
              coalesce(VL_GLOBAL_CONV, 0) AS VL_GLOBAL_CONV, coalesce(VL_REPASSE_CONV, 0) AS VL_REPASSE_CONV,
              coalesce(VL_CONTRAPARTIDA_CONV, 0) AS VL_CONTRAPARTIDA_CONV,
              coalesce(VL_DESEMBOLSADO_CONV, 0) AS VL_DESEMBOLSADO_CONV,
              coalesce(SITUACAO_PROJETO_BASICO, 'missing') AS SITUACAO_PROJETO_BASICO)
           FROM stg),
feat AS (SELECT * EXCLUDE (DIA_INIC_VIGENC_CONV, DIA_FIM_VIGENC_CONV, DIA_FIM_VIGENC_ORIGINAL_CONV),
           VL_REPASSE_CONV / NULLIF(VL_GLOBAL_CONV, 0) AS PERC_REPASSE,
           VL_CONTRAPARTIDA_CONV / NULLIF(VL_GLOBAL_CONV, 0) AS PERC_CONTRA,
           VL_DESEMBOLSADO_CONV / NULLIF(VL_GLOBAL_CONV, 0) AS PERC_DESEMBOLSADO,
           CAST({_date('DIA_FIM_VIGENC_ORIGINAL_CONV')} - {_date('DIA_INIC_VIGENC_CONV')} AS INTEGER) AS DIF_ORIG,
           CAST({_date('DIA_FIM_VIGENC_CONV')} - {_date('DIA_INIC_VIGENC_CONV')} AS INTEGER) AS DIF_PRORROG
         FROM filled)
"""

_BAND = ("CASE WHEN {x} > 0 AND {x} <= 33000 THEN 'dispensa' "
         "WHEN {x} > 33000 AND {x} <= 330000 THEN 'convite' "
         "WHEN {x} > 330000 AND {x} <= 3300000 THEN 'tomada' "
         "WHEN {x} > 3300000 THEN 'concorrencia' END")

MODEL_INPUT_CTE = f"""
mi AS (SELECT NR_CONVENIO, TARGET,
          CAST(QTD_TA AS DOUBLE) AS QTD_TA, CAST(QTD_PRORROGA AS DOUBLE) AS QTD_PRORROGA,
          CAST(QTDE_CONVENIOS AS DOUBLE) AS QTDE_CONVENIOS, CAST(EMENDAS AS DOUBLE) AS EMENDAS,
          CAST(CNPJS_CONSORCIOS AS DOUBLE) AS CNPJS_CONSORCIOS,
          PERC_REPASSE, PERC_CONTRA, PERC_DESEMBOLSADO,
          CAST(DIF_ORIG AS DOUBLE) AS DIF_ORIG, CAST(DIF_PRORROG AS DOUBLE) AS DIF_PRORROG,
          CAST(MES AS VARCHAR) AS MES, UF_PROPONENTE, COD_MUNIC_IBGE, COD_ORGAO_SUP, COD_ORGAO,
          MODALIDADE, SITUACAO_CONTA, SITUACAO_PROJETO_BASICO,
          coalesce({_BAND.format(x='VL_GLOBAL_CONV')}, 'missing') AS FAIXA_VALOR
       FROM feat)
"""


def W(body: str, *extra: str) -> str:
    """Statement with the binding CTEs, the feature CTEs and ``extra`` CTEs."""
    ctes = [BINDING_CTES, FEATURE_CTES, MODEL_INPUT_CTE, *extra]
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def R(sql: str, *cols: str) -> str:
    """Round the named double columns to 6 places."""
    if not cols:
        return sql
    rep = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)  # + 0.0 turns -0.0 into 0.0
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) _r"


_VL = ["VL_GLOBAL_CONV", "VL_REPASSE_CONV", "VL_CONTRAPARTIDA_CONV", "VL_DESEMBOLSADO_CONV"]
_PERC = ["PERC_REPASSE", "PERC_CONTRA", "PERC_DESEMBOLSADO"]
_NUM_DOUBLE = ["QTD_TA", "QTD_PRORROGA", "QTDE_CONVENIOS", "EMENDAS", "CNPJS_CONSORCIOS",
               "PERC_REPASSE", "PERC_CONTRA", "PERC_DESEMBOLSADO", "DIF_ORIG", "DIF_PRORROG"]

# -- projections / filters ---------------------------------------------------------
ORACLE["project_agreements"] = R(W(f"SELECT {_AGR} FROM convenio"), *_VL)
ORACLE["filter_status"] = R(W(f"SELECT * FROM convenio WHERE SIT_CONVENIO IN ({_FINAL})"), *_VL)
ORACLE["union_status"] = R(W(" UNION ALL ".join(
    f"SELECT * FROM convenio WHERE SIT_CONVENIO = {_q(s)}" for s in schemas.FINAL_STATUSES)), *_VL)
ORACLE["label_case"] = W(f"SELECT NR_CONVENIO, SIT_CONVENIO, {_LABEL_CASE.format(c='SIT_CONVENIO')} AS TARGET "
                         "FROM convenio")
ORACLE["drop_columns"] = R(W("SELECT * EXCLUDE (" + ", ".join(schemas.NON_FEATURE_COLUMNS) + ") FROM feat"),
                           *_PERC)
ORACLE["cast_types"] = W("SELECT NR_CONVENIO, CAST(MES AS VARCHAR) AS MES, CAST(QTD_TA AS DOUBLE) AS QTD_TA, "
                         "CAST(EMENDAS AS DOUBLE) AS EMENDAS, CAST(DIF_ORIG AS DOUBLE) AS DIF_ORIG FROM feat")
ORACLE["class_filter"] = R(W("SELECT NR_CONVENIO, VL_GLOBAL_CONV, TARGET FROM feat WHERE TARGET = 1"),
                           "VL_GLOBAL_CONV")
ORACLE["feature_variants"] = R(W(" UNION ALL BY NAME ".join(
    "SELECT *" + (f" EXCLUDE ({', '.join(drops)})" if drops else "") + f", '{v}' AS variant FROM mi"
    for v, drops in schemas.VARIANT_DROPS.items())), *_NUM_DOUBLE)
ORACLE["agency_filter"] = R(W("SELECT * EXCLUDE (COD_MUNIC_IBGE, COD_ORGAO_SUP, COD_ORGAO) FROM mi "
                              "WHERE COD_ORGAO_SUP = '1'"), *_NUM_DOUBLE)

# -- joins / aggregations ------------------------------------------------------------
ORACLE["star_plus"] = R(W(f"SELECT a.*, {_PROP} FROM agr a LEFT JOIN proposta p ON a.ID_PROPOSTA = p.ID_PROPOSTA"),
                        *_VL)
ORACLE["join_proposal_left"] = R(W("SELECT * FROM cp"), *_VL)
ORACLE["amendment_count"] = W("SELECT a.NR_CONVENIO, a.ID_PROPOSTA, CAST(count(e.ID_PROPOSTA) AS BIGINT) AS EMENDAS "
                              "FROM agr a LEFT JOIN emenda e ON a.ID_PROPOSTA = e.ID_PROPOSTA "
                              "GROUP BY a.NR_CONVENIO, a.ID_PROPOSTA")
ORACLE["amendment_count_grouped"] = W(
    "SELECT a.NR_CONVENIO, min(a.ID_PROPOSTA) AS ID_PROPOSTA, min(a.MES) AS MES, "
    "CAST(count(e.ID_PROPOSTA) AS BIGINT) AS EMENDAS "
    "FROM agr a LEFT JOIN emenda e ON a.ID_PROPOSTA = e.ID_PROPOSTA GROUP BY a.NR_CONVENIO")
ORACLE["participant_count_distinct"] = W(
    "SELECT a.NR_CONVENIO, a.ID_PROPOSTA, CAST(count(DISTINCT c.CNPJ_PARTICIPANTE) AS BIGINT) AS CNPJS_CONSORCIOS "
    "FROM agr a LEFT JOIN consorcios c ON a.ID_PROPOSTA = c.ID_PROPOSTA GROUP BY a.NR_CONVENIO, a.ID_PROPOSTA")
ORACLE["participant_pick_compat"] = W(
    "SELECT a.NR_CONVENIO, a.ID_PROPOSTA, CAST(count(k.ID_PROPOSTA) AS BIGINT) AS CNPJS_CONSORCIOS "
    "FROM agr a LEFT JOIN (SELECT CNPJ_PARTICIPANTE, min(ID_PROPOSTA) AS ID_PROPOSTA FROM consorcios "
    "GROUP BY CNPJ_PARTICIPANTE) k ON a.ID_PROPOSTA = k.ID_PROPOSTA GROUP BY a.NR_CONVENIO, a.ID_PROPOSTA")
ORACLE["participant_pick"] = W("SELECT CNPJ_PARTICIPANTE, min(ID_PROPOSTA) AS ID_PROPOSTA FROM consorcios "
                               "GROUP BY CNPJ_PARTICIPANTE")
ORACLE["loose_group"] = R(W(
    "SELECT ID_PROPOSTA, NR_EMENDA, VALOR_REPASSE_EMENDA FROM ("
    "SELECT ID_PROPOSTA, lpad(NR_EMENDA, 3, '0') AS NR_EMENDA, VALOR_REPASSE_EMENDA, "
    "row_number() OVER (PARTITION BY ID_PROPOSTA ORDER BY lpad(NR_EMENDA, 3, '0'), VALOR_REPASSE_EMENDA) AS rn FROM emenda) "
    "WHERE rn = 1"), "VALOR_REPASSE_EMENDA")
ORACLE["feature_table"] = R(W("SELECT * FROM feat"), *_VL, *_PERC)
ORACLE["feature_table_compat"] = R(W(
    "SELECT f.* REPLACE (CAST(coalesce(k.n, 0) AS BIGINT) AS CNPJS_CONSORCIOS) FROM feat f "
    "LEFT JOIN (SELECT ID_PROPOSTA AS kid, count(*) AS n FROM (SELECT CNPJ_PARTICIPANTE, min(ID_PROPOSTA) "
    "AS ID_PROPOSTA FROM consorcios GROUP BY CNPJ_PARTICIPANTE) GROUP BY ID_PROPOSTA) k ON f.ID_PROPOSTA = k.kid"),
    *_VL, *_PERC)

# -- scalar functions -------------------------------------------------------------------
ORACLE["fill_zero"] = R(W("SELECT NR_CONVENIO, " + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in schemas.ZERO_FILL_COLUMNS) + " FROM stg"), *_VL)
ORACLE["fill_missing"] = W("SELECT NR_CONVENIO, coalesce(SITUACAO_PROJETO_BASICO, 'missing') "
                           "AS SITUACAO_PROJETO_BASICO FROM stg")
ORACLE["value_shares"] = R(W(
    "SELECT NR_CONVENIO, VL_REPASSE_CONV / NULLIF(VL_GLOBAL_CONV, 0) AS PERC_REPASSE, "
    "VL_CONTRAPARTIDA_CONV / NULLIF(VL_GLOBAL_CONV, 0) AS PERC_CONTRA, "
    "VL_DESEMBOLSADO_CONV / NULLIF(VL_GLOBAL_CONV, 0) AS PERC_DESEMBOLSADO FROM convenio"), *_PERC)
ORACLE["parse_dates"] = W("SELECT NR_CONVENIO, " + ", ".join(
    f"{_date(c)} AS {c}" for c in schemas.DATE_COLUMNS) + " FROM convenio")
ORACLE["day_diff"] = W(
    f"SELECT NR_CONVENIO, CAST({_date('DIA_FIM_VIGENC_ORIGINAL_CONV')} - {_date('DIA_INIC_VIGENC_CONV')} AS INTEGER) "
    f"AS DIF_ORIG, CAST({_date('DIA_FIM_VIGENC_CONV')} - {_date('DIA_INIC_VIGENC_CONV')} AS INTEGER) AS DIF_PRORROG "
    "FROM convenio")
ORACLE["value_band"] = R(W(
    "SELECT id, value, " + _BAND.format(x="value") + " AS FAIXA_VALOR FROM ("
    "SELECT NR_CONVENIO AS id, VL_GLOBAL_CONV AS value FROM convenio UNION ALL "
    "SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS value FROM customer)"), "value")
ORACLE["separator_repair"] = ("SELECT page_id, regexp_replace(regexp_replace(html, '[ ]+;', ' -', 'g'), "
                              "';[ ]+', '- ', 'g') AS html FROM pages")
ORACLE["decimal_comma"] = R(W(
    "SELECT NR_CONVENIO, VL_GLOBAL_CONV, VL_TEXT, "
    "TRY_CAST(replace(replace(VL_TEXT, '.', ''), ',', '.') AS DOUBLE) AS VL_BACK FROM ("
    "SELECT NR_CONVENIO, VL_GLOBAL_CONV, replace(regexp_replace(CAST(VL_GLOBAL_CONV AS VARCHAR), "
    "'\\.?0+$', ''), '.', ',') AS VL_TEXT FROM convenio)"), "VL_GLOBAL_CONV", "VL_BACK")

# -- reports ----------------------------------------------------------------------------
for _name, (_g, _n) in report.BALANCE_REPORTS.items():
    _body = (f"SELECT {_g}, count(TARGET) AS total, "
             "CAST(sum(CASE WHEN TARGET = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negativos, "
             "CAST(sum(CASE WHEN TARGET = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positivos "
             f"FROM feat GROUP BY {_g}")
    ORACLE[f"class_balance_{_name}"] = W(_body)
    ORACLE[f"top_groups_{_name}"] = W(_body + f" ORDER BY total DESC, {_g} ASC NULLS FIRST LIMIT {_n}")
ORACLE["sql_report"] = ORACLE["class_balance_agency"]
ORACLE["distinct_categories"] = W(" UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM mi"
    for c in schemas.CATEGORICAL_FEATURES))


def _hist_sql(src: str, value: str, label: str, n: int, extra_where: str = "TRUE") -> str:
    data = f"(SELECT * FROM {src} WHERE {value} IS NOT NULL AND {extra_where})"
    rng = (f"(SELECT {label}, min(CAST({value} AS DOUBLE)) AS lo, max(CAST({value} AS DOUBLE)) AS hi "
           f"FROM {data} GROUP BY {label})")
    return f"""
SELECT bins.{label}, CAST(bins.bin AS INTEGER) AS bin,
       lo + CAST(bins.bin AS INTEGER) * ((hi - lo) / {float(n)}) AS lo,
       lo + (CAST(bins.bin AS INTEGER) + 1) * ((hi - lo) / {float(n)}) AS hi,
       CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM (SELECT {label}, lo, hi, unnest(range(0, {n})) AS bin FROM {rng}) bins
LEFT JOIN (
  SELECT s.{label}, CASE WHEN r.hi - r.lo = 0 THEN 0
         ELSE least({n - 1}, CAST(floor((CAST(s.{value} AS DOUBLE) - r.lo) * {n} / (r.hi - r.lo)) AS INTEGER)) END AS bin,
         count(*) AS n
  FROM {data} s JOIN {rng} r ON s.{label} = r.{label}
  GROUP BY 1, 2) cnt
ON bins.{label} = cnt.{label} AND CAST(bins.bin AS INTEGER) = cnt.bin
"""


ORACLE["hist_value"] = R(W("SELECT * FROM (" + _hist_sql("feat", "VL_GLOBAL_CONV", "TARGET", 1000,
                                                          "TARGET IN (0, 1)") + ") h WHERE lo <= 5000000.0"),
                         "lo", "hi")

# -- evaluation tables -----------------------------------------------------------------
_GROUPED = """
g AS (SELECT classifier, probability AS score,
             CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp
      FROM predictions GROUP BY classifier, probability),
c AS (SELECT *, CAST(sum(tp) OVER (PARTITION BY classifier ORDER BY score DESC
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_tp,
                CAST(sum(fp) OVER (PARTITION BY classifier ORDER BY score DESC
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_fp,
                CAST(sum(tp) OVER (PARTITION BY classifier) AS BIGINT) AS P,
                CAST(sum(fp) OVER (PARTITION BY classifier) AS BIGINT) AS N
      FROM g)
"""
_GROUPED_LABELS = _GROUPED.replace("probability AS score", "CAST(prediction AS DOUBLE) AS score") \
    .replace("GROUP BY classifier, probability", "GROUP BY classifier, prediction")

_CONF = ("SELECT classifier, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, "
         "count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, "
         "count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, "
         "count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM predictions GROUP BY classifier")
_SCORES = ("SELECT *, CAST(tp + tn AS DOUBLE) / NULLIF(tp + tn + fp + fn, 0) AS accuracy, "
           "CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) AS recall, "
           "CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0) AS specificity FROM (" + _CONF + ")")
_SCORES_F = ("SELECT *, 2.0 * precision * recall / NULLIF(precision + recall, 0) AS f_measure FROM ("
             + _SCORES + ")")
_AUC = ("SELECT classifier, sum(fp * (cum_tp - tp + tp / 2.0)) / NULLIF(CAST(max(P) AS DOUBLE) * max(N), 0) "
        "AS roc_auc FROM c GROUP BY classifier")
ORACLE["confusion"] = W(_CONF)
ORACLE["scores"] = R(W(_SCORES_F), "accuracy", "precision", "recall", "specificity", "f_measure")
ORACLE["roc_auc"] = R(W(_AUC, _GROUPED), "roc_auc")
_AP = ("SELECT classifier, sum((CAST(tp AS DOUBLE) / NULLIF(P, 0)) * (CAST(cum_tp AS DOUBLE) / NULLIF(cum_tp + cum_fp, 0))) "
       "AS avg_precision FROM c GROUP BY classifier")
ORACLE["avg_precision"] = R(W(_AP, _GROUPED), "avg_precision")
ORACLE["avg_precision_labels"] = R(W(_AP, _GROUPED_LABELS), "avg_precision")
ORACLE["roc_points"] = R(W(
    "SELECT classifier, score AS threshold, CAST(cum_fp AS DOUBLE) / NULLIF(N, 0) AS fpr, "
    "CAST(cum_tp AS DOUBLE) / NULLIF(P, 0) AS tpr FROM c UNION ALL "
    "SELECT DISTINCT classifier, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM c", _GROUPED), "threshold", "fpr", "tpr")
ORACLE["pr_points"] = R(W(
    "SELECT classifier, score AS threshold, CAST(cum_tp AS DOUBLE) / NULLIF(cum_tp + cum_fp, 0) AS precision, "
    "CAST(cum_tp AS DOUBLE) / NULLIF(P, 0) AS recall FROM c UNION ALL "
    "SELECT DISTINCT classifier, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM c", _GROUPED), "threshold", "precision", "recall")
ORACLE["metric_pivot"] = R(W(
    "SELECT s.classifier, s.accuracy AS \"ACU\", s.recall AS \"SEN\", s.specificity AS \"ESP\", "
    "s.precision AS \"PRE\", s.f_measure AS \"F-measure\", a.roc_auc AS \"AUC\" "
    "FROM (" + _SCORES_F + ") s LEFT JOIN (" + _AUC + ") a ON s.classifier = a.classifier", _GROUPED),
    '"ACU"', '"SEN"', '"ESP"', '"PRE"', '"F-measure"', '"AUC"')
ORACLE["misclassified"] = W("SELECT classifier, row_id, label, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS kind "
                            "FROM predictions WHERE prediction <> label")
_RULES = ("rule7", "rule13", "rule_month")
ORACLE["hist_proba_cumulative"] = R(W(
    "SELECT *, CASE WHEN label IN (0) THEN sum(n) OVER (PARTITION BY classifier, label ORDER BY bin DESC "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE sum(n) OVER (PARTITION BY classifier, label ORDER BY bin "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END / sum(n) OVER (PARTITION BY classifier, label) AS cumulative FROM ("
    + " UNION ALL ".join(f"SELECT '{r}' AS classifier, * FROM (" + _hist_sql("predictions", "probability", "label", 50, f"classifier = '{r}'") + ")"
                         for r in _RULES) + ")"), "lo", "hi", "cumulative")

# -- feature preparation ---------------------------------------------------------------
_CAT = schemas.CATEGORICAL_FEATURES
_NUMF = schemas.NUMERIC_FEATURES


def _pairs(cols) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST(NR_CONVENIO AS BIGINT) AS rid, '{c}' AS col, coalesce(CAST({c} AS VARCHAR), 'missing') AS value "
        "FROM mi" for c in cols)


def _codes_cte(cols, name="codes") -> str:
    return (f"{name} AS (SELECT col, value, first_row, CAST(row_number() OVER (PARTITION BY col ORDER BY first_row, value) "
            f"- 1 AS INTEGER) AS code FROM (SELECT col, value, min(rid) AS first_row FROM ({_pairs(cols)}) "
            "GROUP BY col, value))")


ORACLE["first_seen_codes"] = W('SELECT col AS "column", value, code, first_row FROM codes', _codes_cte(_CAT))
_ORD = _CAT
ORACLE["ordinal_encode"] = W(
    "SELECT mi.NR_CONVENIO, " + ", ".join(f"k{i}.code AS {c}_code" for i, c in enumerate(_ORD)) + " FROM mi "
    + " ".join(f"LEFT JOIN codes k{i} ON k{i}.col = '{c}' AND k{i}.value = coalesce(CAST(mi.{c} AS VARCHAR), 'missing')"
               for i, c in enumerate(_ORD)), _codes_cte(_ORD))

# Distinct values of the three low-cardinality columns in the bound data.
_ONEHOT_VALUES = {
    "MODALIDADE": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "SITUACAO_CONTA": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "FAIXA_VALOR": ["convite", "dispensa", "tomada"],
}
ORACLE["onehot_wide"] = W("SELECT NR_CONVENIO, " + ", ".join(
    f"CAST(CASE WHEN {c} = {_q(v)} THEN 1 ELSE 0 END AS INTEGER) AS \"{c}_{v}\""
    for c, vs in _ONEHOT_VALUES.items() for v in vs) + " FROM mi")

_OFFSETS = ("SELECT col, coalesce(sum(n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off "
            "FROM (SELECT col, CASE col " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(_CAT))
            + " END AS pos, count(*) AS n FROM codes GROUP BY col)")
ORACLE["onehot_sparse"] = W(
    "SELECT p.NR_CONVENIO, CAST(o.off + k.code AS BIGINT) AS idx FROM ("
    + " UNION ALL ".join(f"SELECT NR_CONVENIO, '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM mi" for c in _CAT)
    + f") p JOIN codes k ON p.col = k.col AND p.value = k.value JOIN ({_OFFSETS}) o ON o.col = p.col "
    "WHERE p.value IS NOT NULL", _codes_cte(_CAT))

_IMP = ("imp AS (SELECT NR_CONVENIO, " + ", ".join(f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in _NUMF)
        + " FROM mi)")
_STATS = ("st AS (SELECT count(*) AS n, " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, max(abs({c})) AS a_{c}" for c in _NUMF) + " FROM imp)")


def _std_scale(c: str) -> str:
    eps = "2.220446049250313e-16"
    return (f"(CASE WHEN s_{c} IS NULL OR isnan(s_{c}) OR s_{c} * s_{c} <= n * {eps} * (s_{c} * s_{c}) "
            f"+ (n * m_{c} * {eps}) * (n * m_{c} * {eps}) THEN 1.0 ELSE s_{c} END)")


ORACLE["impute_mean"] = R(W("SELECT * FROM imp", _IMP), *_NUMF)
ORACLE["standardize"] = R(W("SELECT NR_CONVENIO, " + ", ".join(
    f"({c} - m_{c}) / {_std_scale(c)} AS {c}" for c in _NUMF) + " FROM imp, st", _IMP, _STATS), *_NUMF)
ORACLE["scale_only"] = R(W("SELECT NR_CONVENIO, " + ", ".join(
    f"{c} / {_std_scale(c)} AS {c}" for c in _NUMF) + " FROM imp, st", _IMP, _STATS), *_NUMF)
ORACLE["maxabs"] = R(W("SELECT NR_CONVENIO, " + ", ".join(
    f"{c} / (CASE WHEN a_{c} IS NULL OR a_{c} = 0 THEN 1.0 ELSE a_{c} END) AS {c}" for c in _NUMF)
    + " FROM imp, st", _IMP, _STATS), *_NUMF)

# -- splits and rebalancing --------------------------------------------------------------


def _mix(i: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || coalesce(CAST({i} AS VARCHAR), '')), 1, 15) AS BIGINT)"


def _holdout(src: str) -> list[str]:
    """CTEs that end in ho (row_id, label, split) for the rows of ``src`` (row_id, label)."""
    return [
        f"cc AS (SELECT label, count(*) AS n_c FROM {src} GROUP BY label)",
        "tot AS (SELECT sum(n_c) AS n, sum(n_c) - CAST(ceil(CAST(0.1 AS DOUBLE) * sum(n_c)) AS BIGINT) AS n_train FROM cc)",
        "fl AS (SELECT label, n_c, CAST(n_c AS DOUBLE) * n_train / n AS cont, floor(CAST(n_c AS DOUBLE) * n_train / n) AS f, "
        "n_train FROM cc, tot)",
        "k AS (SELECT label, n_c - (f + CASE WHEN row_number() OVER (ORDER BY cont - f DESC, label) "
        "<= n_train - sum(f) OVER () THEN 1 ELSE 0 END) AS n_test FROM fl)",
        "ho AS (SELECT l.row_id, l.label, CASE WHEN l.rn <= k.n_test THEN 'test' ELSE 'train' END AS split FROM "
        f"(SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {_mix('row_id', schemas.SEED)}, row_id) "
        f"AS rn FROM {src}) l JOIN k ON l.label = k.label)"]


ORACLE["holdout_split"] = W("SELECT * FROM ho", *_holdout("labelled"))
ORACLE["stratified_folds"] = W(
    "SELECT l.row_id, l.label, b.f AS fold FROM "
    "(SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS r FROM labelled) l "
    "JOIN b ON l.label = b.label AND l.r >= b.lo AND l.r < b.hi",
    "cls AS (SELECT label, count(*) AS n, min(row_id) AS first FROM labelled GROUP BY label)",
    "ord AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY first, label ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND 1 PRECEDING), 0) AS start FROM cls)",
    "alloc AS (SELECT label, CAST(f AS INTEGER) AS f, CAST(floor((start + n - 1 - f) / 10.0) - "
    "floor((start - 1 - f) / 10.0) AS BIGINT) AS cnt FROM ord, range(10) t(f))",
    "b AS (SELECT label, f, sum(cnt) OVER (PARTITION BY label ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND CURRENT ROW) - cnt AS lo, sum(cnt) OVER (PARTITION BY label ORDER BY f ROWS BETWEEN UNBOUNDED "
    "PRECEDING AND CURRENT ROW) AS hi FROM alloc)")
ORACLE["class_weights"] = R(W(
    "SELECT row_id, label, CAST(count(*) OVER () AS DOUBLE) / ((SELECT count(DISTINCT label) FROM labelled) "
    "* count(*) OVER (PARTITION BY label)) AS weight FROM labelled"), "weight")
ORACLE["class_weights_pos"] = W("SELECT row_id, label, CAST(CASE WHEN label = 1 THEN 20.0 ELSE 1.0 END AS DOUBLE) AS weight "
                                "FROM labelled")

_SUMV = "list_reduce(list_prepend(0.0, {v}), lambda a, x: a + x)"
_SQV = "list_reduce(list_prepend(0.0, list_transform({v}, lambda x: x * x)), lambda a, x: a + x)"
_D2 = ("list_reduce(list_prepend(0.0, list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), "
       "lambda s, x: s + x)")


def _smote_ctes(src: str, ratio: float, p: str, seed: int = schemas.SEED, k: int = schemas.SMOTE_K) -> list[str]:
    """CTEs ``{p}_out`` = rows of ``src`` (row_id, label, v) + synthetic rows."""
    return [
        f"{p}_cnt AS (SELECT count(*) FILTER (WHERE label = 1) AS n_min, count(*) FILTER (WHERE label <> 1) AS n_maj "
        f"FROM {src})",
        f"{p}_par AS (SELECT n_min, CAST(trunc(n_maj * CAST({ratio} AS DOUBLE) - n_min) AS BIGINT) AS n_new, "
        f"least({k}, n_min - 1) AS kk FROM {p}_cnt)",
        f"{p}_mino AS (SELECT row_id, v, row_number() OVER (ORDER BY row_id) - 1 AS rk FROM {src} WHERE label = 1)",
        f"{p}_nn AS (SELECT base_id, nb_id, row_number() OVER (PARTITION BY base_id ORDER BY d2, nb_id) - 1 AS pos "
        f"FROM (SELECT a.row_id AS base_id, b.row_id AS nb_id, {_D2.format(a='a.v', b='b.v')} AS d2 "
        f"FROM {p}_mino a JOIN {p}_mino b ON a.row_id <> b.row_id))",
        f"{p}_draw AS (SELECT j, {_mix('j', seed)} % (n_min * kk) AS idx, kk, "
        f"CAST({_mix('j', seed + 1)} AS DOUBLE) / 1152921504606846976.0 AS step "
        f"FROM (SELECT unnest(range(n_new)) AS j, n_min, kk FROM {p}_par))",
        f"{p}_syn AS (SELECT -(d.j + 1) AS row_id, 1 AS label, "
        f"list_transform(list_zip(x.v, y.v), lambda q: q[1] + d.step * (q[2] - q[1])) AS v, "
        f"x.row_id AS base_id, nn.nb_id AS neighbour_id, d.step AS step "
        f"FROM {p}_draw d JOIN {p}_mino x ON x.rk = d.idx // d.kk "
        f"JOIN {p}_nn nn ON nn.base_id = x.row_id AND nn.pos = d.idx % d.kk "
        f"JOIN {p}_mino y ON y.row_id = nn.nb_id)",
        f"{p}_out AS (SELECT row_id, label, v, false AS synthetic, CAST(NULL AS BIGINT) AS base_id, "
        f"CAST(NULL AS BIGINT) AS neighbour_id, CAST(NULL AS DOUBLE) AS step FROM {src} UNION ALL "
        f"SELECT CAST(row_id AS BIGINT), CAST(label AS INTEGER), v, true, base_id, neighbour_id, step FROM {p}_syn)",
    ]


def _nearmiss_ctes(src: str, ratio: float, p: str, k: int = schemas.NEARMISS_K) -> list[str]:
    """CTE ``{p}_out`` = minority rows + kept majority rows with mean_dist."""
    return [
        f"{p}_cnt AS (SELECT count(*) FILTER (WHERE label = 1) AS n_min, count(*) FILTER (WHERE label <> 1) AS n_maj "
        f"FROM {src})",
        f"{p}_d AS (SELECT a.row_id, b.row_id AS mid, {_D2.format(a='a.v', b='b.v')} AS d2 "
        f"FROM (SELECT * FROM {src} WHERE label <> 1) a JOIN (SELECT * FROM {src} WHERE label = 1) b ON true)",
        f"{p}_md AS (SELECT row_id, list_reduce(list_prepend(0.0, list(sqrt(d2) ORDER BY d2, mid)), "
        f"lambda s, x: s + x) / count(*) AS mean_dist FROM (SELECT *, row_number() OVER (PARTITION BY row_id "
        f"ORDER BY d2, mid) AS r FROM {p}_d) WHERE r <= {k} GROUP BY row_id)",
        f"{p}_keep AS (SELECT row_id, mean_dist FROM (SELECT *, row_number() OVER (ORDER BY mean_dist, row_id) AS r "
        f"FROM {p}_md), {p}_cnt WHERE r <= CAST(trunc(n_min / CAST({ratio} AS DOUBLE)) AS BIGINT))",
        f"{p}_out AS (SELECT s.*, CAST(NULL AS DOUBLE) AS mean_dist FROM {src} s WHERE label = 1 UNION ALL "
        f"SELECT s.*, k.mean_dist FROM {src} s JOIN {p}_keep k ON s.row_id = k.row_id)",
    ]


_MAT = "mat AS (SELECT row_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM matrix)"
_SUMMARY = (f"SELECT * EXCLUDE (v), {_SUMV.format(v='v')} AS x_sum, {_SQV.format(v='v')} AS x_norm2 FROM ")
ORACLE["smote"] = R(W(_SUMMARY + "sm_out", _MAT, *_smote_ctes("mat", 0.2, "sm")), "step", "x_sum", "x_norm2")
ORACLE["nearmiss"] = R(W(_SUMMARY + "nm_out", _MAT, *_nearmiss_ctes("mat", 0.2, "nm")),
                       "mean_dist", "x_sum", "x_norm2")
ORACLE["smote_nearmiss"] = R(W(_SUMMARY + "nm_out", _MAT, *_smote_ctes("mat", 0.5, "sm"),
                               *_nearmiss_ctes("sm_out", 0.5, "nm")), "step", "mean_dist", "x_sum", "x_norm2")
ORACLE["resample_plan"] = W("""
SELECT method, ratio, CASE WHEN infeasible THEN NULL ELSE lab END AS label,
       CAST(CASE WHEN infeasible THEN NULL WHEN lab = 0 THEN n0 ELSE n1 END AS BIGINT) AS n,
       CASE WHEN infeasible THEN 'infeasible' END AS error
FROM (
  SELECT method, ratio, n0, n1, (n_new < 0 OR n0 > n_maj) AS infeasible
  FROM (
    SELECT m.method, r.ratio, c.n_maj,
           CASE WHEN m.method = 'nearmiss' THEN 0 ELSE CAST(trunc(c.n_maj * r.ratio - c.n_min) AS BIGINT) END AS n_new,
           CASE m.method WHEN 'smote' THEN c.n_maj
                WHEN 'nearmiss' THEN CAST(trunc(c.n_min / r.ratio) AS BIGINT)
                ELSE CAST(trunc((c.n_min + CAST(trunc(c.n_maj * r.ratio - c.n_min) AS BIGINT)) / r.ratio) AS BIGINT)
           END AS n0,
           CASE m.method WHEN 'nearmiss' THEN c.n_min
                ELSE c.n_min + CAST(trunc(c.n_maj * r.ratio - c.n_min) AS BIGINT) END AS n1
    FROM (SELECT count(*) FILTER (WHERE label = 1) AS n_min, count(*) FILTER (WHERE label <> 1) AS n_maj
          FROM matrix) c,
         (VALUES ('smote'), ('nearmiss'), ('smote_nearmiss')) m(method),
         (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.2 AS DOUBLE)), (CAST(1.0 AS DOUBLE))) r(ratio)) x) y,
  (VALUES (0), (1)) l(lab)
WHERE NOT infeasible OR lab = 0
""")

# -- sources / sinks: a lossless round trip reproduces the source query -----------------
ORACLE["csv_roundtrip"] = ORACLE["feature_table"]
ORACLE["etl_from_files"] = ORACLE["feature_table"]
ORACLE["stage_tables"] = ORACLE["feature_table"]
ORACLE["stream_load"] = ORACLE["filter_status"]


# -- assembled matrices: imputed numerics then first-seen codes, summed in vector order --
def _tree_total(src: str, cats: list[str], label_expr: str, key: str, extra_cols: str = "") -> str:
    num_terms = [f"coalesce({c}, avg({c}) OVER ())" for c in _NUMF]
    code_terms = [f"k{i}.code" for i in range(len(cats))]
    total = "0.0"
    for t in num_terms + code_terms:
        total = f"({total} + {t})"
    joins = " ".join(f"LEFT JOIN codes k{i} ON k{i}.col = '{c}' AND k{i}.value = coalesce(CAST(s.{c} AS VARCHAR), "
                     "'missing')" for i, c in enumerate(cats))
    pairs = " UNION ALL ".join(
        f"SELECT rid, '{c}' AS col, coalesce(CAST({c} AS VARCHAR), 'missing') AS value FROM {src}" for c in cats)
    codes = (f"codes AS (SELECT col, value, CAST(row_number() OVER (PARTITION BY col ORDER BY first_row, value) - 1 "
             f"AS INTEGER) AS code FROM (SELECT col, value, min(rid) AS first_row FROM ({pairs}) GROUP BY col, value))")
    body = (f"SELECT {key}{extra_cols}, {label_expr}, {total.replace('coalesce(', 'coalesce(s.').replace('avg(', 'avg(s.')} "
            f"AS total FROM {src} s {joins}")
    return codes, body


def _code_entries(one: str) -> str:
    """(NR_CONVENIO, label, col, code) of every category as ``one`` says."""
    return (f"SELECT p.NR_CONVENIO, p.label, {one} FROM (" + " UNION ALL ".join(
        f"SELECT NR_CONVENIO, TARGET AS label, '{c}' AS col, coalesce(CAST({c} AS VARCHAR), 'missing') AS value FROM mi" for c in _CAT)
        + f") p JOIN codes k ON p.col = k.col AND p.value = k.value JOIN ({_OFFSETS}) o ON o.col = p.col")


_POS_OF = "CASE p.col " + " ".join(f"WHEN '{c}' THEN {len(_NUMF) + i}" for i, c in enumerate(_CAT)) + " END"
_KEEP = "SELECT NR_CONVENIO, label, CAST(idx AS INTEGER) AS idx, CAST(value AS DOUBLE) AS value FROM ({}) WHERE round(value, 6) <> 0"
ORACLE["tree_matrix"] = R(W(_KEEP.format(" UNION ALL ".join(
    [f"SELECT NR_CONVENIO, TARGET AS label, {i} AS idx, coalesce({c}, avg({c}) OVER ()) AS value FROM mi" for i, c in enumerate(_NUMF)]
    + [_code_entries(f"{_POS_OF} AS idx, CAST(k.code AS DOUBLE) AS value")])), _codes_cte(_CAT)), "value")
_VAR_CAT = [c for c in _CAT if c not in schemas.VARIANT_DROPS["sem_municipio_orgao"]]
_SV_CODES, _SV_BODY = _tree_total("mi3", _VAR_CAT, "CAST(TARGET AS DOUBLE) AS label", "rid")
ORACLE["libsvm_zero_based"] = R(W("SELECT label, total FROM (" + _SV_BODY + ")",
                                  "mi3 AS (SELECT *, CAST(NR_CONVENIO AS BIGINT) AS rid FROM mi "
                                  "WHERE TARGET IS NOT NULL)", _SV_CODES), "total")


# -- remaining inventory rows -------------------------------------------------------------
ORACLE["column_roles"] = W(" UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", 'numeric' AS role, {i} AS position, count({c}) AS n_present FROM mi"
     for i, c in enumerate(_NUMF)]
    + [f"SELECT '{c}', 'categorical', {len(_NUMF) + i}, count({c}) FROM mi" for i, c in enumerate(_CAT)]))
ORACLE["shuffle_order"] = W(
    f"SELECT row_id, row_number() OVER (ORDER BY {_mix('row_id', schemas.SEED)}, row_id) AS position "
    "FROM (SELECT CAST(NR_CONVENIO AS BIGINT) AS row_id FROM feat)")
ORACLE["metric_report"] = W(
    "SELECT s.classifier, printf('%.3f', s.accuracy) AS \"ACU\", printf('%.3f', s.recall) AS \"SEN\", "
    "printf('%.3f', s.specificity) AS \"ESP\", printf('%.3f', s.precision) AS \"PRE\", "
    "printf('%.3f', s.f_measure) AS \"F-measure\", printf('%.3f', a.roc_auc) AS \"AUC\" "
    "FROM (" + _SCORES_F + ") s LEFT JOIN (" + _AUC + ") a ON s.classifier = a.classifier", _GROUPED)

_FOLDS = """
cls AS (SELECT classifier, label, count(*) AS n, min(row_id) AS first FROM predictions GROUP BY classifier, label),
ord AS (SELECT classifier, label, n, coalesce(sum(n) OVER (PARTITION BY classifier ORDER BY first, label
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM cls),
alloc AS (SELECT classifier, label, CAST(f AS INTEGER) AS f, CAST(floor((start + n - 1 - f) / 10.0)
          - floor((start - 1 - f) / 10.0) AS BIGINT) AS cnt FROM ord, range(10) t(f)),
b AS (SELECT classifier, label, f, sum(cnt) OVER (PARTITION BY classifier, label ORDER BY f ROWS BETWEEN
      UNBOUNDED PRECEDING AND CURRENT ROW) - cnt AS lo, sum(cnt) OVER (PARTITION BY classifier, label ORDER BY f
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM alloc),
pf AS (SELECT p.*, b.f AS fold FROM (SELECT *, row_number() OVER (PARTITION BY classifier, label ORDER BY row_id) - 1
       AS r FROM predictions) p JOIN b ON p.classifier = b.classifier AND p.label = b.label AND p.r >= b.lo
       AND p.r < b.hi),
fc AS (SELECT classifier, fold, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
       count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
       count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM pf GROUP BY classifier, fold),
fs AS (SELECT classifier, fold, CAST(tp + tn AS DOUBLE) / NULLIF(tp + tn + fp + fn, 0) AS accuracy,
       CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) AS recall,
       CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0) AS specificity FROM fc),
fl AS (SELECT classifier, fold, metric, value FROM (
       SELECT *, 2.0 * precision * recall / NULLIF(precision + recall, 0) AS f_measure FROM fs)
       UNPIVOT (value FOR metric IN (accuracy, precision, recall, specificity, f_measure)))
"""
ORACLE["fold_summary_scores"] = R(W(
    "SELECT classifier, metric, avg(value) AS mean, stddev_samp(value) AS stdev FROM fl GROUP BY classifier, metric",
    _FOLDS), "mean", "stdev")
ORACLE["feature_table_bucketed"] = ORACLE["feature_table"]


def _linear_total_sql() -> str:
    cats = _VAR_CAT
    imp = ("li AS (SELECT CAST(TARGET AS DOUBLE) AS label, " + ", ".join(
        f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in _NUMF) + " FROM mi WHERE TARGET IS NOT NULL)")
    st = ("st AS (SELECT count(*) AS n, " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _NUMF)
          + " FROM li)")
    total = "0.0"
    for c in _NUMF:
        total = f"({total} + ({c} - m_{c}) / {_std_scale(c)})"
    for _ in cats:
        total = f"({total} + 1.0)"
    width = ("(SELECT CAST(count(*) AS INTEGER) + " + str(len(_NUMF)) + " FROM (SELECT DISTINCT col, value FROM ("
             + " UNION ALL ".join(f"SELECT '{c}' AS col, coalesce(CAST({c} AS VARCHAR), 'missing') AS value FROM mi "
                                  "WHERE TARGET IS NOT NULL" for c in cats) + ")))")
    return W(f"SELECT label, {width} AS width, {total} AS total FROM li, st", imp, st)


ORACLE["libsvm_roundtrip"] = R(_linear_total_sql(), "total")


# Feature names of the linear matrix: numerics, then one block per categorical
# column in code (first-seen) order, named <column>_oh_<value>.
_CAT_POS = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(_CAT))
ORACLE["feature_names"] = W(
    "SELECT CAST(idx AS INTEGER) AS idx, name FROM ("
    + " UNION ALL ".join(f"SELECT {i} AS idx, '{c}' AS name" for i, c in enumerate(_NUMF))
    + f" UNION ALL SELECT {len(_NUMF)} + c.off + k.code AS idx, k.col || '_oh_' || k.value AS name "
    "FROM codes k JOIN (SELECT col, coalesce(sum(n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND "
    f"1 PRECEDING), 0) AS off FROM (SELECT col, CASE col {_CAT_POS} END AS pos, count(*) AS n FROM codes "
    "GROUP BY col)) c ON k.col = c.col)", _codes_cte(_CAT))

# Text file of page bodies, one value per line: line breaks (\n, \r\n, \r) split rows.
ORACLE["separator_repair_file"] = (
    "SELECT unnest(string_split(regexp_replace(regexp_replace(regexp_replace(html, '[ ]+;', ' -', 'g'), "
    "';[ ]+', '- ', 'g'), '\\r\\n?', chr(10), 'g'), chr(10))) AS value FROM pages")
_LINES = ("SELECT unnest(string_split(regexp_replace(html, '\\r\\n?', chr(10), 'g'), chr(10))) AS value "
          "FROM pages")
_FIXED = "regexp_replace(regexp_replace(value, '[ ]+;', ' -', 'g'), ';[ ]+', '- ', 'g')"
ORACLE["separator_report"] = (
    "SELECT value, seps_before, seps_after FROM (SELECT value, "
    "CAST(length(value) - length(replace(value, ';', '')) AS INTEGER) AS seps_before, "
    f"CAST(length({_FIXED}) - length(replace({_FIXED}, ';', '')) AS INTEGER) AS seps_after FROM ({_LINES})) "
    "WHERE seps_before <> seps_after")


def _linear_matrix_sql() -> str:
    """Every non-zero entry of the linear matrix (variant 'all')."""
    imp = ("la AS (SELECT NR_CONVENIO, TARGET AS label, " + ", ".join(
        f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in _NUMF) + " FROM mi)")
    # centre with the mean that was imputed (mean of the present values)
    st = ("sa AS (SELECT (SELECT count(*) FROM la) AS n, " + ", ".join(
        f"(SELECT avg({c}) FROM mi) AS m_{c}, (SELECT stddev_pop({c}) FROM la) AS s_{c}" for c in _NUMF) + ")")
    eps = "2.220446049250313e-16"
    parts = []
    for i, c in enumerate(_NUMF):
        const = (f"(s_{c} IS NULL OR isnan(s_{c}) OR s_{c} * s_{c} <= n * {eps} * (s_{c} * s_{c}) "
                 f"+ (n * m_{c} * {eps}) * (n * m_{c} * {eps}))")
        parts.append(f"SELECT NR_CONVENIO, label, {i} AS idx, CASE WHEN {const} THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END AS value FROM la, sa")
    parts.append(_code_entries(f"{len(_NUMF)} + o.off + k.code AS idx, 1.0 AS value"))
    return R(W(_KEEP.format(" UNION ALL ".join(parts)), imp, st, _codes_cte(_CAT)), "value")


ORACLE["linear_matrix"] = _linear_matrix_sql()
ORACLE["append_load"] = R(W("SELECT * FROM convenio UNION ALL SELECT * FROM convenio"), *_VL)
ORACLE["scan_with_dates"] = R(W("SELECT * REPLACE (" + ", ".join(f"{_date(c)} AS {c}" for c in schemas.DATE_COLUMNS)
                                + ") FROM convenio"), *_VL)

# -- learners with closed forms, hold-out rows, plans ---------------------------------------
_LAB = "lab AS (SELECT CAST(NR_CONVENIO AS BIGINT) AS row_id, CAST(TARGET AS INTEGER) AS label, EMENDAS >= 4 AS x FROM mi WHERE TARGET IS NOT NULL)"
_SHARES = ("w AS (SELECT *, CAST(count(*) OVER () AS DOUBLE) / (2 * count(*) OVER (PARTITION BY label)) AS weight FROM lab)",
           "sh AS (SELECT x, sum(weight * label) / sum(weight) AS p FROM w GROUP BY x)")
ORACLE["logit_closed_form"] = W("SELECT row_id, label, round(p, 3) AS probability FROM lab JOIN sh USING (x)", _LAB, *_SHARES)
ORACLE["gbt_closed_form"] = R(W(
    "SELECT row_id, label, 1 / (1 + exp(-2 * (2 * p - 1))) AS probability, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction "
    "FROM lab JOIN sh USING (x)", _LAB, *_SHARES), "probability")
ORACLE["importance_closed_form"] = W(
    "SELECT 0 AS idx, 'many_amendments' AS name, CAST(count(*) > 1 AS INTEGER)::DOUBLE AS importance FROM sh "
    "UNION ALL SELECT 1, 'constant', 0.0::DOUBLE", _LAB, *_SHARES)
ORACLE["mlp_holdout"] = W("SELECT row_id, label, TRUE AS agree FROM ho WHERE split = 'test'", _LAB, *_holdout("lab"))
ORACLE["model_roundtrip_equal"] = W("SELECT row_id, label, TRUE AS same FROM ho WHERE split = 'test'", _LAB, *_holdout("lab"))
ORACLE["grid_plan"] = (
    "SELECT fold, n_valid, positives, CAST(sum(n_valid) OVER (PARTITION BY trial) - n_valid AS BIGINT) AS n_train, trial, "
    "learning_rate, max_depth, n_estimators FROM (SELECT fold, count(*) AS n_valid, CAST(sum(label) AS BIGINT) AS positives FROM ("
    + ORACLE["stratified_folds"] + ") GROUP BY fold), (SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS INTEGER) AS trial, "
    "a::DOUBLE AS learning_rate, b::DOUBLE AS max_depth, c::DOUBLE AS n_estimators FROM (VALUES (0.001), (0.01), (0.1)) r(a), "
    "(VALUES (5), (6), (7), (8), (10), (12)) d(b), (VALUES (50), (100), (150), (200), (250)) e(c))")
ORACLE["best_trial"] = (
    "SELECT CASE classifier WHEN 'rule13' THEN 0 WHEN 'rule7' THEN 1 ELSE 2 END AS trial, roc_auc AS score, "
    "CAST(length(classifier) AS DOUBLE) AS name_length FROM (" + ORACLE["roc_auc"] + ") ORDER BY score DESC, trial LIMIT 1")
_TRAIN_MEANS = "tm AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in _NUMF) + " FROM mi JOIN ho ON ho.row_id = CAST(NR_CONVENIO AS BIGINT) WHERE split = 'train')"
_FILLED = "fi AS (SELECT row_id, split, " + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in _NUMF) + " FROM mi JOIN ho ON ho.row_id = CAST(NR_CONVENIO AS BIGINT), tm)"
_TRAIN_STATS = "st AS (SELECT count(*) AS n, " + ", ".join(f"stddev_pop({c}) AS s_{c}" for c in _NUMF) + " FROM fi WHERE split = 'train')"
ORACLE["standardize_train"] = R(W(
    "SELECT row_id, split, " + ", ".join(f"({c} - m_{c}) / {_std_scale(c)} AS {c}" for c in _NUMF) + " FROM fi, tm, st",
    _LAB, *_holdout("lab"), _TRAIN_MEANS, _FILLED, _TRAIN_STATS), *_NUMF)

# -- forward pass of given weights, a tree by enumeration, entries, components, neighbours ---------
ORACLE["mlp_closed_form"] = R(W(
    "SELECT row_id, label, p AS probability, CAST(p > 0.5 AS INTEGER) AS prediction FROM (SELECT row_id, label, "
    "1 / (1 + exp((0.7 * h1 - 1.1 * h2 + 0.05) - (-0.4 * h1 + 0.9 * h2 + 0.3))) AS p FROM (SELECT row_id, label, "
    "1 / (1 + exp(-(x::INT + 0.1))) AS h1, 1 / (1 + exp(-(-2.0 * x::INT - 0.2))) AS h2 FROM lab))", _LAB), "probability")


def _level(n: int) -> list[str]:
    """CTEs n{n + 1} (rows with their next node) from n{n}: best split of each node over all columns, cuts and directions."""
    return [
        f"e{n} AS (SELECT node, 0 AS feature, a AS v, g, h FROM n{n} UNION ALL SELECT node, 1, b, g, h FROM n{n})",
        f"t{n} AS (SELECT node, feature, sum(g) AS ag, sum(h) AS ah, coalesce(sum(g) FILTER (v IS NULL), 0) AS ng, "
        f"coalesce(sum(h) FILTER (v IS NULL), 0) AS nh FROM e{n} GROUP BY ALL)",
        f"u{n} AS (SELECT node, feature, v, sum(sum(g)) OVER w AS lg, sum(sum(h)) OVER w AS lh FROM e{n} WHERE v IS NOT NULL "
        f"GROUP BY node, feature, v WINDOW w AS (PARTITION BY node, feature ORDER BY v))",
        f"c{n} AS (SELECT node, feature, v, ml, ag, ah, lg + CASE WHEN ml THEN ng ELSE 0 END AS gl, lh + CASE WHEN ml THEN nh ELSE 0 END AS hl "
        f"FROM u{n} JOIN t{n} USING (node, feature), (VALUES (false), (true)) m(ml))",
        f"s{n} AS (SELECT *, round((gl * gl / (hl + 1) + (ag - gl) * (ag - gl) / (ah - hl + 1) - ag * ag / (ah + 1)) / 2, 9) AS gain FROM c{n} "
        f"WHERE hl >= 1 AND ah - hl >= 1)",
        f"b{n} AS (SELECT * FROM s{n} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, v, ml) = 1)",
        f"n{n + 1} AS (SELECT row_id, label, n.a, n.b, g, h, CASE WHEN feature IS NULL THEN n.node ELSE 2 * n.node + CASE WHEN "
        f"coalesce(CASE WHEN feature = 0 THEN n.a ELSE n.b END <= s.v, s.ml) THEN 0 ELSE 1 END END AS node "
        f"FROM n{n} n LEFT JOIN (SELECT node, feature, v, ml FROM b{n}) s ON s.node = n.node)"]


ORACLE["boost_closed_form"] = R(W(
    "SELECT row_id, label, 1 / (1 + exp(0.3 * sum(g) OVER w / (sum(h) OVER w + 1))) AS probability, "
    "CAST(sum(g) OVER w < 0 AS INTEGER) AS prediction FROM n2 WINDOW w AS (PARTITION BY node)",
    "bl AS (SELECT CAST(NR_CONVENIO AS BIGINT) AS row_id, CAST(TARGET AS INTEGER) AS label, least(EMENDAS, 3.0) AS a, "
    "CASE WHEN DIF_PRORROG IS NOT NULL THEN least(greatest(floor(DIF_PRORROG / 200), -1), 3) END AS b FROM mi WHERE TARGET IS NOT NULL)",
    "bw AS (SELECT *, CAST(count(*) OVER () AS DOUBLE) / (2 * count(*) OVER (PARTITION BY label)) AS wt FROM bl)",
    "n0 AS (SELECT row_id, label, a, b, wt * (0.5 - label) AS g, wt * 0.25 AS h, 1 AS node FROM bw)", *_level(0), *_level(1)), "probability")
ORACLE["boost_contributions"] = W("SELECT row_id, label, TRUE AS adds_up FROM ho WHERE split = 'test'", _LAB, *_holdout("lab"))
ORACLE["libsvm_entries"] = f"SELECT NR_CONVENIO, idx, value FROM ({ORACLE['linear_matrix']}) _e"


def _components(method: str, ratio: float, p: str) -> tuple[list[str], str]:
    """CTEs, and the rows of a resampler at a ratio, none if it can't be made."""
    new = "(SELECT n_new >= 0 FROM {0}_par)"
    keep = "(SELECT CAST(trunc(n_min / CAST({1} AS DOUBLE)) AS BIGINT) <= n_maj FROM {0}_cnt)"
    if method == "smote":
        ctes, out, ok = _smote_ctes("mat", ratio, p), f"{p}_out", new.format(p)
    elif method == "nearmiss":
        ctes, out, ok = _nearmiss_ctes("mat", ratio, p), f"{p}_out", keep.format(p, ratio)
    else:
        ctes = _smote_ctes("mat", ratio, p) + _nearmiss_ctes(f"{p}_out", ratio, f"{p}n")
        out, ok = f"{p}n_out", f"{new.format(p)} AND {keep.format(p + 'n', ratio)}"
    return ctes, (f"SELECT '{method}' AS method, CAST({ratio} AS DOUBLE) AS ratio, row_id, label, unnest(v) AS value, "
                  f"CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS position FROM {out} WHERE {ok}")


_PLAN = [(_m, _r) for _m in ("smote", "nearmiss") for _r in schemas.RESAMPLE_RATIOS] + \
    [("smote_nearmiss", _r) for _r in schemas.SMOTE_NEARMISS_RATIOS]
_PARTS = [_components(_m, _r, f"x{_i}") for _i, (_m, _r) in enumerate(_PLAN)]
ORACLE["resample_components"] = R(W(" UNION ALL ".join(q for _, q in _PARTS), _MAT, *[c for ctes, _ in _PARTS for c in ctes]), "value")
_TRUE = ("nb AS (SELECT a.vec_id AS row_id, b.vec_id AS neighbour_id, "
         + _D2.format(a="list_transform(a.embedding, lambda x: CAST(x AS DOUBLE))", b="list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))")
         + " AS d2 FROM embeddings a JOIN embeddings b ON a.label = 0 AND b.label <> 0)")
ORACLE["neighbours_exact"] = R(
    f"WITH {_TRUE} SELECT row_id, CAST(r - 1 AS INTEGER) AS rank, neighbour_id, d2 FROM (SELECT *, row_number() OVER "
    "(PARTITION BY row_id ORDER BY d2, neighbour_id) AS r FROM nb) WHERE r <= 5", "d2")
ORACLE["neighbours_recall"] = "SELECT count(*) * 5 AS neighbours, TRUE AS enough FROM embeddings WHERE label = 0"
ORACLE["rejected_values"] = (
    "SELECT CAST(o_orderkey AS VARCHAR) AS \"KEY\", 'PRICE' AS \"column\", 'n/d' AS text FROM orders WHERE o_orderkey % 97 = 0 UNION ALL "
    "SELECT CAST(o_orderkey AS VARCHAR), 'DAYS', CASE WHEN o_orderkey % 53 = 1 THEN o_orderkey || 'x' ELSE '1,5' END "
    "FROM orders WHERE o_orderkey % 53 = 1 OR o_orderkey % 97 = 0")
