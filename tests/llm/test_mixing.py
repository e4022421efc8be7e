from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from grantrisk.llm import mixing
from grantrisk.llm.common import staged


def brute_targets(sizes, weights=(5, 2, 1), most=3.0):
    """Share by weight; cut at the cap; share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    left = float(total)
    while left > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        give = {s: target[s] + left * weight[s] / w for s in open_}
        target |= {s: min(give[s], most * sizes[s]) for s in open_}
        left = total - sum(target.values())
        open_ = {s for s in open_ if target[s] < most * sizes[s] - 1e-9}
    return target


def check(rows, sizes):
    want = brute_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def mixed(docs):
    items = staged(mixing.items_of(docs), "t")
    return mixing.apply_mix(items, mixing.plan_mix(items)).collect()


def test_targets_are_reshared(docs_of):
    docs, sizes, i = [], defaultdict(int), 0
    for source, n in (("a", 4), ("b", 400), ("c", 40), ("d", 900), (None, 30), ("é", 3), ("empty", 2)):
        for k in range(n):
            words = 0 if source == "empty" else 1 + (k * 7) % 12
            docs.append((i, "w " * words, "en", source))
            sizes[source] += words
            i += 1
    rows = mixed(docs_of(*docs))
    assert len(rows) == len(docs)
    check(rows, dict(sizes))
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in mixed(docs_of(*reversed(docs)))}


def test_odd_documents(odd_docs, no_docs):
    rows = mixed(odd_docs)
    sizes = defaultdict(int)
    for r in odd_docs.collect():
        sizes[r.source] += len((r.text or "").split())
    assert len(rows) == odd_docs.count()
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    check(rows, dict(sizes))
    assert mixed(no_docs) == [] and mixing.mix_sources(no_docs).count() == 0
    assert mixing.mix_sources(odd_docs).columns == odd_docs.columns


def test_better_documents_are_taken_more_often(docs_of):
    docs = [(i, "words and more words" if i % 2 else "1234 5678 910 11 a", "en", "a") for i in range(4000)]
    items = staged(mixing.items_of(docs_of(*docs)), "t")
    rows = mixing.apply_mix(items, mixing.plan_mix(items, share=0.3)).collect()
    good, poor = (sum(r.copies for r in rows if r.doc_id % 2 == k) for k in (1, 0))
    assert good > 4 * poor
    assert abs(sum(r.taken for r in rows) - 0.3 * sum(r["size"] for r in rows)) <= 5


def test_mix_repeats_documents(docs_of):
    docs = [(i, "one two three", "en", "a" if i < 10 else "b") for i in range(100)]
    df = docs_of(*docs)
    items = staged(mixing.items_of(df), "t")
    want = {r.doc_id: r.copies for r in mixing.apply_mix(items, mixing.plan_mix(items)).collect()}
    got = defaultdict(int)
    for r in mixing.mix_sources(df).collect():
        got[r.doc_id] += 1
    assert got == {i: n for i, n in want.items() if n}
    assert max(want.values()) == 3


def test_ids_of_any_type_and_weights_of_ones_own(spark):
    rows = [(f"doc-{i}" if i % 7 else None, "w " * (1 + i % 9), "ab"[i % 2], float(1 + i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, w double")
    items = staged(mixing.items_of(df, weight=F.col("w")), "t")
    got = mixing.apply_mix(items, mixing.plan_mix(items)).collect()
    check(got, {s: sum(r["size"] for r in got if r.source == s) for s in "ab"})
    out = mixing.mix_sources(df, weight=F.col("w"))
    assert out.columns == df.columns and out.count() > 0
    heavy = df.withColumn("w", F.when(F.col("text") == "w ", 1e6).otherwise(1.0))
    items = staged(mixing.items_of(heavy, weight=F.col("w")), "t")
    taken = mixing.apply_mix(items, mixing.plan_mix(items, share=0.3)).where("size = 1")
    assert taken.where("taken = 0").count() == 0


def test_a_source_of_least_weight_is_spread_over_the_buckets(spark):
    df = spark.range(30000).selectExpr("id as doc_id", "'# # #' as text", "if(id % 3 = 0, 'a', 'b') as source")
    items = mixing.items_of(df)
    n = items.select(mixing._bucket(F.col("key")).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
    assert n < 40
    got = mixing.apply_mix(staged(items, "t"), mixing.plan_mix(staged(items, "t"))).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 3 for r in got)
