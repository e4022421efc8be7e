"""The pipeline's stages against brute-force versions of each, on the smallest table."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import __spark_entry__
import corpus_pipeline
from grantrisk.llm import bpe, fertility, mixing, simhash
from grantrisk.llm.common import staged, table

from .test_lines import brute
from .test_simhash import brute_groups


def test_stages_in_order(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mix_sources", "bpe"]
    docs = table(spark, sf, "documents")
    columns, whole = docs.columns, {r.doc_id: r for r in docs.collect()}
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf), "t")
        at[name] = docs.collect()
        assert name == "bpe" or docs.columns == columns

    frame = staged(fertility.measured(table(spark, sf, "documents"), into="m"), "t")
    kept = {r.doc_id for r in fertility.judged(frame, "m").where("m_kept").collect()}
    assert {r.doc_id for r in at["quality_rules"]} == kept and kept < set(whole)
    assert all(r == whole[r.doc_id] for r in at["quality_rules"])

    before = [(r.doc_id, r.text) for r in at["quality_rules"]]
    assert {r.doc_id: r.text for r in at["line_dedup"]} == {i: t for (i, _), (_, _, t) in zip(before, brute(before))}
    assert all(r.n_chars == len(r.text) for r in at["line_dedup"])

    lines = sorted(at["line_dedup"])
    label = brute_groups([simhash.fingerprint_of(r.text, 4) & (1 << 64) - 1 for r in lines])
    assert {r.doc_id for r in at["simhash_near_dedup"]} == {lines[k].doc_id for k in label}
    assert len(at["simhash_near_dedup"]) == len(set(label)) < len(lines)

    items = staged(mixing.items_of(spark.createDataFrame(at["simhash_near_dedup"], docs_schema(spark, sf))), "t")
    copies = {r.doc_id: r.copies for r in mixing.apply_mix(items, mixing.plan_mix(items)).collect() if r.copies}
    seen = {}
    for r in at["mix_sources"]:
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == copies

    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})
    texts = {r.doc_id: r.text for r in at["mix_sources"]}
    assert len(at["bpe"]) == len(at["mix_sources"])
    for r in at["bpe"]:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def docs_schema(spark, sf):
    return table(spark, sf, "documents").schema


def test_run_is_the_stages(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf), "t")
    key = ["doc_id", "n_tokens", "ids_sha256"]
    assert sorted(corpus_pipeline.run(spark, sf).select(*key).collect()) == sorted(docs.select(*key).collect())


def test_empty_and_odd_documents(spark, sf, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in corpus_pipeline.STAGES:
            now = staged(stage(spark, now, sf), "t")
        assert now.count() <= 3 * start.count()


def test_registration():
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert "pipeline" not in __spark_entry__.oracle_sql()
