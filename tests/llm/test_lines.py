import random

import numpy as np
import pytest

from grantrisk.llm import lines

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(docs, least=10):
    """[(id, text)] -> [(n_lines, n_dropped, text)], by the definition."""
    def key(line):
        k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))
        return k if len(k) >= least else None

    order = lambda i: (i is None, i)
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if key(line) is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if key(x) is None or len(holders[key(x)]) < 2 or min(holders[key(x)], key=order) == i]
        out.append((len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def run(df):
    got = lines.drop_lines(df, counts=("n_lines", "n_dropped"))
    assert [c for c in got.columns if c not in ("text", "n_lines", "n_dropped")] == [c for c in df.columns if c != "text"]
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()))


def expected(docs):
    return sorted((i is None, i or 0, *x) for (i, _), x in zip(docs, brute(docs)))


def test_against_brute_force(docs_of):
    rng = random.Random(3)
    pool = [f"{w} repeated line number {w}" for w in ("alpha", "beta", "gamma", "Ünï", "漢字漢字漢字漢字漢字")] + ["short", "", "  ", "exactly 10", "nine char"]
    docs = []
    for i in range(60):
        text = "\n".join(rng.choice([x, x.upper(), f" {x}\t", f"{x} {rng.random()}"]) for x in rng.choices(pool, k=rng.randrange(8)))
        docs.append((rng.choice([i, i, i, None, 7]), text if i % 9 else None))
    df = docs_of(*[(i, t, "en", "a") for i, t in docs])
    assert run(df) == expected(docs)


def test_odd_documents_and_hot_line(docs_of, odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(100 + i, f"a line that all of them hold\nown {i} and more") for i in range(300)]
    df = odd_docs.unionByName(docs_of(*[(i, t, "en", "a") for i, t in docs[odd_docs.count():]]))
    assert run(df) == expected(docs)


def test_null_text_stays_null(docs_of):
    assert lines.drop_lines(docs_of((1, None, "en", "a"))).first().text is None


def test_empty_table(no_docs):
    assert lines.drop_lines(no_docs).count() == 0


def test_merged_filters_lose_no_repeat():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    bits, seen = 1 << 16, []
    for part in (keys[:2500], keys[2000:]):
        f = lines._Filters(bits)
        f.add(part)
        seen.append(f)
    merged = seen[0].twice | seen[1].twice | (seen[0].once & seen[1].once)
    assert lines._hit(merged, lines._positions(keys[2000:2500], bits)).all()


@pytest.mark.parametrize("n, bits", [(0, 1 << 20), (1 << 18, 1 << 21), ((1 << 18) + 1, 1 << 22), (10 ** 12, 1 << 28)])
def test_filter_size_is_bounded(n, bits):
    assert lines.filter_bits(n) == bits


def test_saturated_filter_gives_the_same(docs_of, monkeypatch):
    docs = [(i, f"line of document {i % 20} here\nunique line {i} of this one") for i in range(200)]
    monkeypatch.setattr(lines, "filter_bits", lambda n: 64)
    monkeypatch.setattr(lines, "SEGMENT_BITS", 64)
    assert run(docs_of(*[(i, t, "en", "a") for i, t in docs])) == expected(docs)
