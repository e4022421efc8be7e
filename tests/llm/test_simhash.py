import random
import re

import numpy as np
import pytest
import xxhash

from grantrisk.llm import simhash
from grantrisk.llm.queries import op7_simhash


def brute_fingerprint(text, k=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i:i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, max_bits=4):
    """Label of each fingerprint: index of the first in its component."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= max_bits and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("text", [None, "", " \n", "one", "A b C d", "one two three four five six", "É à É à É à x", "w " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint_of(text, 4) & (1 << 64) - 1 == brute_fingerprint(text)


def test_radii_cover_the_distance():
    for m in range(1, 7):
        for r in range(0, 9):
            assert sum(x + 1 for x in simhash.radii(m, r)) == r + 1


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_links_against_brute_force(spark, segments):
    rng = random.Random(segments)
    fps = {0}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            f = base
            for b in rng.sample(range(64), rng.randrange(7)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    marked = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.groups(marked, 4, segments).collect()}
    assert [got[f] for f in signed] == brute_groups(fps)


def test_crowded_table_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "PAIRS", 16)
    rng = random.Random(5)
    base = rng.getrandbits(63)
    fps = sorted({base} | {base ^ (1 << rng.randrange(48, 63)) ^ (1 << rng.randrange(20)) ^ (rng.getrandbits(1) << rng.randrange(40)) for _ in range(150)})
    marked = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.groups(marked).collect()}
    assert [got[f] for f in fps] == brute_groups(fps)


def test_odd_documents(odd_docs, no_docs):
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    blank = {r.component_id for r in found if r.fp == 0}
    assert blank == {3}
    assert {r.component_id for r in found if r.doc_id in (1, 2)} == {1}
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 3), (False, 6), (False, 7), (True, 0)]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_query_against_brute_force(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    fps = [simhash.fingerprint_of(r.text, 4) & (1 << 64) - 1 for r in docs]
    assert fps[:40] == [brute_fingerprint(r.text) for r in docs[:40]]
    label = brute_groups(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op7_simhash(spark, sf).collect()}
    assert got == {r.doc_id: (f"{f:016x}", docs[k].doc_id) for r, f, k in zip(docs, fps, label)}
    assert np.unique(label).size < len(label)
