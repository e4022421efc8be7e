import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from grantrisk.llm import codes
from grantrisk.llm.common import staged
from grantrisk.llm.queries import op13_codes


def nearest(part, book):
    return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))


def brute(rows, parts=16, entries=64, rounds=2):
    """[(vec_id, code, error, label_error)] and the digest, by the definition in plain integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    cut = []
    for _, v, _ in rows:
        v = [math.floor(256 * x) for x in v]
        w = len(v) // parts
        cut.append([v[p * w:(p + 1) * w] for p in range(parts)])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1]))
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            near = [nearest(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, k in zip(cut, near) if k == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    label = {r[2]: sum(e for e, s in zip(error, rows) if s[2] == r[2]) for r in rows}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(r[0], "".join(f"{i:02x}" for _, i in f), e, label[r[2]]) for r, f, e in zip(rows, found, error)], key=repr), digest


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=4, max_size=4), min_size=1, max_size=20),
       st.lists(st.lists(st.integers(-4, 4), min_size=4, max_size=4), min_size=1, max_size=12))
def test_search_finds_the_nearest_and_lowest(points, entries):
    entries = np.array(entries, dtype=np.int64).reshape(-1, 2, 2).transpose(1, 0, 2)
    points = np.array(points, dtype=np.int64).reshape(-1, 2, 2)
    found, d = codes.search(points, codes.neighbour_lists(entries))
    for i, point in enumerate(points):
        for p in range(2):
            assert (d[i, p], found[i, p]) == nearest(point[p], entries[p])


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows],
                               "vec_id long, embedding array<double>, label string, code string, error string, group_of_total string")
    books = codes.fit(df, **options)
    out = codes.with_group_error(staged(codes.encode(df, books), "t"))
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()), key=repr), books.sha256()


def test_odd_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=32).round(1).tolist(), "ab"[i % 2] if i % 5 else None) for i in range(150)]
    rows += [(7, rows[7][1], "a")] * 2 + [(500 + i, rows[3][1], None) for i in range(40)]
    good = rows + [(900, [0.0] * 32, "c"), (901, [-1e-9] * 32, "c")]
    odd = [(1000, None, "a"), (1001, [None] + rows[0][1][1:], "a"), (1002, [float("nan")] + rows[0][1][1:], "a"),
           (1003, [float("inf")] + rows[0][1][1:], None), (-1, [], "a"), (1005, [1.0] * 8, "a")]
    got, digest = run(spark, good + odd, entries=16)
    assert (got, digest) == brute(good, entries=16)


def test_few_vectors_huge_components_and_widths_that_parts_dont_divide(spark):
    got, _ = run(spark, [(1, [0.5] * 16, None)])
    assert got == [(1, "00" * 16, 0, 0)]
    got, _ = run(spark, [(1, [0.0] * 18, None), (2, [1e300] * 18, None), (None, [-1e300] * 18, "a")], parts=4)
    assert [g[1] for g in sorted(got, key=lambda g: g[1])] == ["00000000", "01010101", "02020202"] and all(g[2] == 0 for g in got)


def test_codes_decode_to_near_vectors(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    books = codes.fit(df, parts=4, entries=64)
    out = codes.decode(codes.encode(df, books), books).join(df, "vec_id").collect()
    assert len(out) == 300
    for r in out:
        error = sum((a - b) ** 2 for a, b in zip(r.decoded, r.embedding))
        assert abs(math.sqrt(error) - math.sqrt(r.error) / 256) < 8 / 256


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    books = codes.fit(df)
    assert codes.encode(df, books).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = op13_codes(spark, sf).collect()
    expected, digest = brute(rows)
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=repr) == expected
    assert {r.codebooks_sha256 for r in got} == {digest}
