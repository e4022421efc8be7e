from pyspark.sql import functions as F

from grantrisk import schemas
from grantrisk.operators import relational as rel
from grantrisk.plans import etl


def _fixture(spark):
    agr = spark.createDataFrame([("n1", "p1"), ("n2", "p2"), ("n3", "p9")], "NR_CONVENIO string, ID_PROPOSTA string")
    prop = spark.createDataFrame([("p1", "X"), ("p2", "Y")], "ID_PROPOSTA string, UF_PROPONENTE string")
    em = spark.createDataFrame([("p1",), ("p1",), ("p2",)], "ID_PROPOSTA string")
    members = spark.createDataFrame([("p1", "A"), ("p1", "B"), ("p2", "A")], "ID_PROPOSTA string, CNPJ_PARTICIPANTE string")
    return agr, prop, em, members


def test_joins_and_counts(spark):
    agr, prop, em, members = _fixture(spark)
    j = rel.left_join_columns(agr, prop, "ID_PROPOSTA", ["UF_PROPONENTE"])
    assert {r[0]: r[2] for r in j.collect()} == {"n1": "X", "n2": "Y", "n3": None}
    c = rel.count_matches(agr, em, "ID_PROPOSTA", "EMENDAS")
    assert {r[0]: r[2] for r in c.collect()} == {"n1": 2, "n2": 1, "n3": 0}
    g = rel.count_matches_grouped(agr, em, "ID_PROPOSTA", "NR_CONVENIO", "EMENDAS")
    assert {r[0]: r[2] for r in g.collect()} == {"n1": 2, "n2": 1, "n3": 0}
    d = rel.participants_distinct(agr, members, "ID_PROPOSTA", "CNPJ_PARTICIPANTE", "n")
    assert {r[0]: r[2] for r in d.collect()} == {"n1": 2, "n2": 1, "n3": 0}
    p = rel.participants_compat(agr, members, "ID_PROPOSTA", "CNPJ_PARTICIPANTE", "n")
    assert {r[0]: r[2] for r in p.collect()} == {"n1": 2, "n2": 0, "n3": 0}


def test_duplicate_right_keys_fan_out(spark):
    agr, prop, _, _ = _fixture(spark)
    dup = prop.unionByName(prop.filter(F.col("ID_PROPOSTA") == "p1"))
    assert rel.left_join_columns(agr, dup, "ID_PROPOSTA", ["UF_PROPONENTE"]).count() == 4


def test_status_label_and_filter(spark):
    statuses = schemas.FINAL_STATUSES + ["Em execução", "inadimplente", None]
    df = spark.createDataFrame([(s,) for s in statuses], "SIT_CONVENIO string")
    lab = [r[0] for r in df.select(rel.label_from_status("SIT_CONVENIO")).collect()]
    assert lab == [0, 0, 1, 1, 1, None, None, None]
    kept = rel.keep_values(df, "SIT_CONVENIO", schemas.FINAL_STATUSES)
    union = rel.union_of_filters(df, "SIT_CONVENIO", schemas.FINAL_STATUSES)
    assert sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in union.collect())
    assert kept.count() == 5


def test_class_balance_keeps_null_group(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), (None, 1), (None, None), ("b", 0)], "g string, TARGET int")
    rows = {r["g"]: (r["total"], r["negativos"], r["positivos"]) for r in rel.class_balance(df, "g").collect()}
    assert rows == {"a": (2, 1, 1), None: (1, 0, 1), "b": (1, 1, 0)}
    top = rel.top_groups(rel.class_balance(df, "g"), "g", 1).collect()
    assert top[0]["g"] == "a"


def test_loose_group_picks_smallest_tiebreak(spark):
    df = spark.createDataFrame([("k", 2, "x"), ("k", 1, "y"), (None, 5, "z")], "key string, t int, v string")
    got = {r["key"]: r["v"] for r in rel.loose_group(df, "key", "t").collect()}
    assert got == {"k": "y", None: "z"}


def test_feature_maths(spark):
    row = ("n1", "p1", schemas.STATUS_NEGATIVE[0], None, 1, 3, None, 100.0, 80.0, 20.0, None,
           "01/02/2020", "01/03/2020", "31/02/2020", "UF", "m", "o", "oo", "mod", "id", "sc", None, 0, 2, 1)
    schema = ("NR_CONVENIO string, ID_PROPOSTA string, SIT_CONVENIO string, QTD_TA int, QTD_PRORROGA int, "
              "MES int, QTDE_CONVENIOS int, VL_GLOBAL_CONV double, VL_REPASSE_CONV double, "
              "VL_CONTRAPARTIDA_CONV double, VL_DESEMBOLSADO_CONV double, DIA_INIC_VIGENC_CONV string, "
              "DIA_FIM_VIGENC_CONV string, DIA_FIM_VIGENC_ORIGINAL_CONV string, UF_PROPONENTE string, "
              "COD_MUNIC_IBGE string, COD_ORGAO_SUP string, COD_ORGAO string, MODALIDADE string, "
              "IDENTIF_PROPONENTE string, SITUACAO_CONTA string, SITUACAO_PROJETO_BASICO string, TARGET int, "
              "EMENDAS long, CNPJS_CONSORCIOS long")
    f = etl.feature_maths(spark.createDataFrame([row], schema)).first()
    assert f["QTD_TA"] == 0 and f["QTDE_CONVENIOS"] == 0 and f["VL_DESEMBOLSADO_CONV"] == 0.0
    assert f["SITUACAO_PROJETO_BASICO"] == "missing"
    assert f["PERC_REPASSE"] == 0.8 and f["PERC_DESEMBOLSADO"] == 0.0
    assert f["DIF_PRORROG"] == 29 and f["DIF_ORIG"] is None


def test_grouped_count_with_duplicate_left_rows(spark):
    agr = spark.createDataFrame([("n1", "p1", 1), ("n1", "p1", 2), ("n2", "p2", 3), ("n3", None, 4)],
                                "NR_CONVENIO string, ID_PROPOSTA string, MES int")
    em = spark.createDataFrame([("p1",), ("p1",), ("p1",), ("p2",), (None,)], "ID_PROPOSTA string")
    g = {r["NR_CONVENIO"]: (r["EMENDAS"], r["MES"])
         for r in rel.count_matches_grouped(agr, em, "ID_PROPOSTA", "NR_CONVENIO", "EMENDAS", "MES").collect()}
    assert g == {"n1": (6, 1), "n2": (1, 3), "n3": (0, 4)}
