import zlib
from collections import Counter, defaultdict

import numpy as np

from grantrisk.llm import sharding
from grantrisk.llm.queries import op1_sharding


def laws(rows, n):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(0 <= s < n for s in slots)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_placement_prefers_the_emptiest_fitting_shard():
    vectors = np.array([[0.9, 0.1], [0.1, 0.8], [0.05, 0.6], [0.6, 0.05]])
    assert sharding.place(vectors, 2).tolist() == [0, 1, 0, 1]


def test_odd_documents(odd_docs, no_docs):
    got = sharding.shard_documents(odd_docs, 3).collect()
    laws(got, 3)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert sharding.shard_documents(no_docs, 3).count() == 0


def test_groups_stay_together_and_sizes_are_even(docs_of):
    docs = [(i, f"text {i % 700} " * (1 + i % 13), "en", "a") for i in range(3000)]
    got = sharding.shard_documents(docs_of(*docs), 8).collect()
    laws(got, 8)
    where = defaultdict(set)
    for r in got:
        where[r.text_key].add(r.shard)
    assert all(len(v) == 1 for v in where.values())
    for column in ("size", "tokens"):
        load = Counter()
        for r in got:
            load[r.shard] += r[column]
        assert max(load.values()) < 1.05 * sum(load.values()) / 8
    rows = Counter(r.shard for r in got)
    assert max(rows.values()) < 1.05 * 3000 / 8


def test_a_group_with_a_third_of_all_rows_is_dealt_out(docs_of):
    docs = [(i, "the same text in very many copies" if i % 3 == 0 else f"text number {i} of its own kind", "en", "a") for i in range(6000)]
    repeated = [(9, "the same text in very many copies", "en", "a")] * 1000
    got = sharding.shard_documents(docs_of(*docs, *repeated), 10).collect()
    laws(got, 10)
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert len(load) == 10 and max(load.values()) < 1.1 * sum(load.values()) / 10


def test_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_sharding(spark, sf).collect()
    laws(got, 40)
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in docs.items()}
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_query_balances_a_larger_table(spark):
    load, rows = Counter(), 0
    for r in op1_sharding(spark, "/root/testdata/sf0.1").select("shard", "size").collect():
        load[r.shard] += r["size"]
        rows += 1
    assert rows == 10000 and len(load) == 40
    assert max(load.values()) < 1.02 * min(load.values())


def test_write_shards_writes_every_row_once(spark, odd_docs, tmp_path):
    sharding.write_shards(odd_docs, str(tmp_path / "a"), 3)  # NULL ids, repeated rows, a column shard
    back = spark.read.parquet(str(tmp_path / "a"))
    assert back.columns == [*odd_docs.columns, "shard_"]
    assert Counter(back.drop("shard_").collect()) == Counter(odd_docs.collect())
    plain = odd_docs.drop("shard")
    sharding.write_shards(plain, str(tmp_path / "b"), 3)
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.columns == [*plain.columns, "shard"] and Counter(back.drop("shard").collect()) == Counter(plain.collect())
