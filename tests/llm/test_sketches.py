import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from grantrisk.llm import sketches
from grantrisk.llm.queries import op11_fingerprints


def paragraphs(text):
    """Paragraphs of one text by the rule, byte by byte."""
    raw, out, begin = (text or "").encode(), [], 0
    for i in range(1, len(raw)):
        cut = raw[i - 1] == 10
        if not cut and i >= 5:
            h = 0
            for c in raw[i - 5:i - 1]:
                h = (h + c) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            cut = (raw[i - 1] == 32 and h % 4 == 0) or (raw[i] & 0xC0 != 0x80 and h % 256 == 1)
        if cut:
            out.append(raw[begin:i])
            begin = i
    return out + [raw[begin:]] if raw else []


def alike(a, b):
    a, b = Counter(paragraphs(a)), Counter(paragraphs(b))
    both = a.total() + b.total()
    return 1 - ((a - b).total() + (b - a).total()) / both if both else 1.0


def brute(rows):
    """(id, n_chars, sha, near_edited, near_next) by the definition."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64(r[1].encode(), seed=42).intdigest()
                                                                  - (1 << 64) * (xxhash.xxh64(r[1].encode(), seed=42).intdigest() >> 63)))
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        edited = t[:len(t) - k] + after[:k]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), alike(t, edited), alike(t, after)))
    return sorted(out, key=repr)


def figures(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in df.collect()), key=repr)


def same(got, expected):
    return [g[:3] for g in got] == [e[:3] for e in expected] and np.allclose([g[3:] for g in got], [e[3:] for e in expected])


TEXT = st.text(st.sampled_from(list("ab cd é漢\n  .")), max_size=80)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_paragraphs_of_a_batch(texts):
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    starts = sketches.paragraph_starts(np.frombuffer(b"".join(raw), np.uint8), bounds)
    expected = [b + s for b, t in zip(bounds, texts) for s in np.cumsum([0, *map(len, paragraphs(t))])[:-1]]
    assert starts.tolist() == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=4))
def test_likeness_is_that_of_the_paragraphs(pairs):
    keys = sketches.keys_of([t.encode() for p in zip(*pairs) for t in p])
    n = len(pairs)
    assert np.allclose(sketches.likeness(keys, np.arange(n), np.arange(n) + n), [alike(a, b) for a, b in pairs])


def test_large_differences_take_larger_sketches():
    texts = [" ".join(f"w{i}-{j}" for i in range(n)).encode() for j, n in enumerate((10, 300, 3000, 3000, 40000))]
    keys = sketches.keys_of(texts)
    a, b = np.array([0, 1, 2, 4, 4]), np.array([1, 2, 3, 0, 4])
    key, sign, at = sketches.differences(keys, a, b)
    for i, (x, y) in enumerate(zip(a, b)):
        one, two = (set(keys.key[keys.starts[t]:keys.starts[t + 1]].tolist()) for t in (x, y))
        assert set(key[(at == i) & (sign > 0)].tolist()) == one - two and set(key[(at == i) & (sign < 0)].tolist()) == two - one
    whole, _, _, _ = sketches.peel(sketches.sketch(*keys.of(np.array([4])), 1, sketches.CELLS))
    assert not whole.any()


def test_versions_differ_in_the_edited_paragraphs(spark):
    old = "\n".join(f"line-{i}" for i in range(40))
    new = old.replace("line-7\n", "line-seven\n") + "\nline-41"
    rows = [(1, old, new, "x"), (2, old, old, "x"), (3, None, "", "x"), (4, None, "line 1", "x"), (5, "line 1\nline 1\n", "line 1\n", "x"),
            (6, old, "\n".join(f"other {i}" for i in range(900)), "x")]
    df = spark.createDataFrame(rows, "id long, old string, new string, added string")
    texts = {r.id: r for r in sketches.compare_texts(df, "old", "new").collect()}
    prints = sketches.fingerprints(sketches.fingerprints(df, "old", "a"), "new", "b")
    short = {r.id: r for r in sketches.compare_fingerprints(prints, "a", "b").collect()}
    digest = {xxhash.xxh64_intdigest(p): p for t in (old, new) for p in paragraphs(t)}
    gone, come = ([digest[d % (1 << 64)] for d in texts[1][c]] for c in ("removed", "added"))
    assert b"line-7\n" in gone and b"line-41" in come and len(gone) <= 3 and len(come) <= 5
    for i in (1, 2, 3, 4, 5):
        assert (short[i].removed, short[i].added) == (texts[i].removed, texts[i].added)
        assert texts[i].likeness == pytest.approx(alike(rows[i - 1][1], rows[i - 1][2]))
    assert short[6].removed is None and len(texts[6].added) >= 900
    assert texts[2].likeness == texts[3].likeness == 1 and texts[4].likeness == 0


def test_odd_documents(odd_docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    out = sketches.edit_figures(odd_docs)
    assert out.columns == ["doc_id", *sketches._OUT.names]
    assert same(figures(out), brute(rows))


def test_equal_texts_have_equal_fingerprints(spark, monkeypatch):
    rows = [(i, f"text {i % 3} " * (i % 3) if i % 3 else None) for i in range(60)] + [(7, "one id")] * 5 + [(7, "again")]
    out = sketches.edit_figures(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(out) == len(rows)
    assert len({r.fingerprint for r in out}) == 5
    for r in out:
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)
    assert same(sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in out), key=repr), brute(rows))


def test_one_row_and_empty_table(spark, no_docs):
    one = sketches.edit_figures(spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(9, 1.0)]
    assert sketches.edit_figures(no_docs).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = op11_fingerprints(spark, sf)
    assert same(figures(out), brute(rows))
