import numpy as np

from grantrisk.llm import vectors
from grantrisk.llm.queries import op3_embeddings


def brute(rows, at_least=0.98):
    """{row index: (n_links, component id)} by the definition."""
    def ok(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [ok(v, label) for _, v, label in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1])
             and np.dot(rows[i][1], rows[j][1]) / np.linalg.norm(rows[i][1]) / np.linalg.norm(rows[j][1]) >= at_least] for i in range(n)]
    label = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            least = min([label[i], *[label[j] for j in near[i]]])
            if least < label[i]:
                label[i], changed = least, True
    return sorted((rows[i][0], len(near[i]), label[i], label[i] == rows[i][0]) for i in range(n))


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "vec_id long, embedding array<float>, label int, entry string, near string, n string")
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, **options).collect())


def cluster(rng, n, width, noise):
    centre = rng.normal(size=width)
    return [(centre + noise * rng.normal(size=width)).astype(np.float32).tolist() for _ in range(n)]


def test_clusters_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    found = [v for _ in range(6) for v in cluster(rng, 12, 16, 0.12)] + [rng.normal(size=16).astype(np.float32).tolist() for _ in range(60)]
    rows = [(i, v, i % 2) for i, v in enumerate(found)]
    rows += [(1000 + i, found[3], 1) for i in range(20)] + [(2000, (2 * np.array(found[3], np.float32)).tolist(), 1)]  # copies, a multiple
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [None] + found[3][1:], 1), (3004, [float("nan")] + found[3][1:], 1),
             (3005, [float("inf")] + found[3][1:], 1), (3006, found[3], None), (3007, found[3][:8], 1), (3008, found[3][:8], 1),
             (3009, found[3] + [0.0], 1)]
    got, expected = run(spark, rows), brute(rows)
    assert sum(x[1] for x in got) >= 0.9 * sum(x[1] for x in expected)
    assert got == expected


def test_crowded_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, v, 0) for i, v in enumerate(cluster(rng, 150, 24, 0.09) + cluster(rng, 60, 24, 0.1))]
    assert run(spark, rows) == brute(rows)


def test_few_vectors(spark):
    assert run(spark, [(1, [1.0, 0.0], 3)]) == [(1, 0, 1, True)]
    rows = [(5, [1.0, 0.0], 3), (4, [1.0, 0.1], 3), (3, [1.0, 0.1], 4), (2, None, None)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicates(df).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in op3_embeddings(spark, sf).collect())
    assert got == brute(rows)


def test_huge_and_tiny_doubles_link_by_their_direction(spark):
    rows = [(1, [1e200, 0.0], 1), (2, [3e-200, 1e-202], 1), (3, [0.0, 1e300], 1), (4, [5e-324, 1e-10], 1), (5, [1.0, 0.01], 1), (6, [0.0, -0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 5: (2, 1), 3: (1, 3), 4: (1, 3), 6: (0, 6)}


def test_query_on_planted_links(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, v, int(i % 3)) for i, v in enumerate([v for _ in range(30) for v in cluster(rng, 5, 64, 0.1)])]
    rows = [(i, v, (i // 5) % 3 if i % 10 else None) for i, v, _ in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in op3_embeddings(spark, str(tmp_path)).collect())
    expected = brute(rows)
    assert sum(r[1] for r in expected) > 300
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in expected)
