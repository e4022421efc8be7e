import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from grantrisk.operators import balance as bal
from grantrisk.operators import neighbours


def lists(df):
    return {r.row_id: [(x.d2, x.id) for x in r.nn] for r in df.collect()}


def onehot(rng, n, width=60, kinds=3):
    """Rows as a linear matrix has them: two dense columns, one-hot groups, repeats, an empty row."""
    rows = []
    for i in range(n):
        v = {0: round(float(rng.normal()), 2), 1: float(rng.integers(3))}
        v |= {2 + int(rng.zipf(1.5)) % (width - 2): 1.0 for _ in range(kinds)}
        rows.append({k: x for k, x in v.items() if x})
    rows[-1] = {}
    rows[: n // 5] = [rows[0]] * (n // 5)  # many equal rows: ties by id
    return rows


@pytest.mark.parametrize("max_bytes", [1 << 20, 4000])
def test_sparse_rows_have_the_neighbours_of_the_same_rows_written_out(spark, max_bytes):
    rng = np.random.default_rng(2)
    rows = onehot(rng, 260)
    dense = [[r.get(j, 0.0) for j in range(60)] for r in rows]
    kind = [Vectors.dense(d) if i % 3 == 0 else Vectors.sparse(60, r) for i, (r, d) in enumerate(zip(rows, dense))]
    df = spark.createDataFrame([(i, v, d) for i, (v, d) in enumerate(zip(kind, dense))], ["row_id", "v", "embedding"])
    few = df.where("row_id % 4 <> 0")
    expected = lists(bal.knn(df, few, 5, engine="sql"))
    assert lists(bal.knn(df, few, 5, vec="v", max_bytes=max_bytes)) == expected
    expected = lists(bal.knn(few, few, 4, exclude_self=True, engine="sql"))
    assert lists(bal.knn(few, few, 4, vec="v", exclude_self=True, max_bytes=max_bytes)) == expected


def test_smote_and_nearmiss_of_sparse_rows_equal_those_of_dense_ones(spark):
    rng = np.random.default_rng(3)
    rows = onehot(rng, 200)
    data = [(i, int(i % 9 == 0), Vectors.sparse(60, r), [r.get(j, 0.0) for j in range(60)]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, ["row_id", "label", "features", "embedding"])
    for method, ratio in (("smote", 0.3), ("nearmiss", 0.3), ("smote_nearmiss", 0.5)):
        one = {r.row_id: r.features for r in bal.resample(df.drop("embedding"), method, ratio, vec="features").collect()}
        two = {r.row_id: r.embedding for r in bal.resample(df.drop("features"), method, ratio).collect()}
        assert one.keys() == two.keys() and len(one) > 50
        assert all(np.array_equal(one[i].toArray(), two[i]) for i in one)


def test_chunks_of_queries_and_parts_of_rings_copy_no_more_than_they_must(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 20)
    rng = np.random.default_rng(4)
    data = [(i, [0.0] * 4 if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(150)]  # a third are one point
    df = spark.createDataFrame(data, "row_id long, embedding array<double>")
    assert lists(bal.knn(df, df, 3, exclude_self=True, max_bytes=1500)) == lists(bal.knn(df, df, 3, exclude_self=True, engine="sql"))
    refs, cells = neighbours.build_cells(df.selectExpr("row_id as rid", "embedding as vec"), 20)
    assert refs.count() == 150 and cells.parts.sum() >= 8
    assert refs.groupBy("block", "part").count().agg({"count": "max"}).first()[0] <= 60


def test_search_to_a_recall(spark):
    m = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id as row_id", "label", "embedding")
    refs, queries = m.where("label % 3 <> 0"), m.where("label % 3 = 0")
    true = lists(bal.knn(queries, refs, 5, max_bytes=20000))
    found = lists(bal.knn(queries, refs, 5, max_bytes=20000, recall=0.95))
    share = np.mean([len({x for _, x in found[q]} & {x for _, x in true[q]}) / 5 for q in true])
    assert share >= 0.95
    q = queries.selectExpr("row_id as qid", "transform(embedding, x -> double(x)) as vec")
    r, cells = neighbours.build_cells(refs.selectExpr("row_id as rid", "transform(embedding, x -> double(x)) as vec"), 20)
    assert neighbours.probes_for(q, r, cells, 5, False, ["vec"], 0.5) < neighbours.probes_for(q, r, cells, 5, False, ["vec"], 0.99)


def test_a_query_is_sent_to_a_shelf_once_with_the_parts_that_it_visits(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(200)], "rid long, vec array<double>")
    refs, cells = neighbours.build_cells(df, 10)
    near = np.ones((3, len(cells.cell)), dtype=bool)
    near[1] = False
    first, ring, shelf = cells.pieces()
    assert len(ring) == cells.parts.sum() >= 10 and not shelf.any()
    visits = neighbours._listed(cells, near)[0].to_pylist()
    assert visits == [[{"shelf": 0, "pieces": list(range(len(ring)))}], [], [{"shelf": 0, "pieces": list(range(len(ring)))}]]
