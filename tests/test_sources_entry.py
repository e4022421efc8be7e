import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from grantrisk import schemas
from grantrisk.session import scratch_path
from grantrisk.sources import libsvm as svm
from grantrisk.sources import text as txt
from grantrisk.streaming.append_load import stream_extracts

SF = "/root/testdata/sf0.001"


def test_extract_roundtrip_with_registry(spark):
    df = spark.createDataFrame([("007", "Inadimplente", 3, 1234.5), ("8", "Em execução", None, None)],
                               "NR_CONVENIO string, SIT_CONVENIO string, MES int, VL_GLOBAL_CONV double")
    folder = scratch_path(spark, "t_extract")
    txt.export_csv(df, txt.extract_path(folder, "convenio"))
    back = txt.load_tables(spark, folder, ["convenio"], allow_missing=True)["convenio"]
    assert back.columns == schemas.TABLE_COLUMNS["convenio"]
    r = back.collect()
    assert len(r) == 1 and r[0]["NR_CONVENIO"] == "007" and r[0]["VL_GLOBAL_CONV"] == 1234.5


def test_libsvm_roundtrips(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    df = spark.createDataFrame([(1.0, Vectors.dense([0.0, 2.5, 0.0])), (0.0, Vectors.sparse(3, {0: 1.0}))],
                               schema)
    for zb in (False, True):
        p = scratch_path(spark, "t_svm")
        svm.write_libsvm(df, p, zero_based=zb)
        back = svm.read_libsvm(spark, p, 3, zero_based=zb).collect()
        assert sorted((r["label"], tuple(r["features"].toArray())) for r in back) == \
            [(0.0, (1.0, 0.0, 0.0)), (1.0, (0.0, 2.5, 0.0))]


def test_stream_append_is_exactly_once(spark):
    df = spark.createDataFrame([("1", schemas.STATUS_POSITIVE[0]), ("2", "Em execução")],
                               "NR_CONVENIO string, SIT_CONVENIO string")
    src, dst, ck = (scratch_path(spark, n) for n in ("t_in", "t_out", "t_ck"))
    txt.export_csv(df, src)
    stream_extracts(spark, src, "convenio", dst, ck, allow_missing=True)
    stream_extracts(spark, src, "convenio", dst, ck, allow_missing=True)
    assert spark.read.parquet(dst).count() == 1


def test_entry_runs(spark):
    out = E.entry(spark)
    assert out.count() > 0 and "TARGET" in out.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["feature_table", "class_balance_agency", "roc_auc", "stratified_folds",
                                  "first_seen_codes", "standardize"])
def test_oracle_agreement_small(spark, name):
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    s = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    norm = lambda v: "<null>" if v is None else (repr(round(v, 6)) if isinstance(v, float) else str(v))
    cols = sorted(s.columns)
    assert cols == sorted(rel.columns)
    a = sorted(tuple(norm(r[c]) for c in cols) for r in s.collect())
    idx = [rel.columns.index(c) for c in cols]
    b = sorted(tuple(norm(r[i]) for i in idx) for r in rel.fetchall())
    assert a == b


def test_bucketed_stage_equals_plain(spark):
    from grantrisk.plans import etl
    from grantrisk.plans import queries as Q
    from grantrisk.session import cluster_conf
    plain = Q.QUERIES["feature_table"](spark, SF)
    bucketed = Q.QUERIES["feature_table_bucketed"](spark, SF)
    cols = plain.columns
    assert plain.select(*cols).exceptAll(bucketed.select(*cols)).count() == 0
    assert bucketed.select(*cols).exceptAll(plain.select(*cols)).count() == 0
    assert int(cluster_conf(100 * 2**40, 8000)["spark.sql.shuffle.partitions"]) == 409600
    assert etl.KEY == "ID_PROPOSTA"
