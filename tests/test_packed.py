"""Rows packed into blocks: every component comes back, and a reader holds a small part of a table of blocks."""

import pyarrow.parquet as pq
from pyspark.ml.linalg import Vectors

from grantrisk.operators import packed


def _rows(n):
    # component 0: every row, 1: half of the rows, 2: a few of value 1, 3 + i: cold, one row each; others twice with values of their own
    return [(i, i % 3, i % 2, 1.0 + i, Vectors.sparse(3 + 2 * n, sorted({0: i + 0.5, **({1: 1.0} if i % 2 else {}), **({2: 1.0} if i % 5 == 0 else {}),
             3 + i: 1.0, **({3 + n + i // 2: -2.0} if i % 7 == 0 else {})}.items()))) for i in range(n)]


def test_blocks_give_back_every_component(spark):
    rows = _rows(400)
    df = spark.createDataFrame(rows, ["row_id", "fold", "label", "weight", "features"])
    data = packed.pack(df, "fold", "label", "weight", "features")
    assert data.width <= 803 and data.rows == {0: 134, 1: 133, 2: 133}
    batch = data.blocks.toArrow()
    found = set()
    for b in packed.blocks_of(batch.to_batches()):
        for r in range(len(b.label)):
            at = {int(c): float(v) for c, v in zip(b.hot, b.dense[r]) if v}
            at |= {int(c): float(v) for q, c, v in zip(b.row, b.column, b.value) if q == r}
            found.add((int(b.fold[r]), float(b.label[r]), float(b.weight[r]), tuple(sorted(at.items()))))
    want = {(f, float(y), w, tuple(sorted((int(i), float(x)) for i, x in zip(v.indices, v.values)))) for _, f, y, w, v in rows}
    assert found == want


def test_row_groups_of_blocks_are_small(spark, monkeypatch):
    monkeypatch.setattr(packed, "ENTRIES", 64)
    monkeypatch.setattr(packed, "GROUP_BYTES", 1 << 13)
    df = spark.createDataFrame([(i, i % 2, 1.0, Vectors.sparse(9, [0, 1 + i % 8], [i + 0.25, 1.0])) for i in range(4000)],
                               ["row_id", "label", "weight", "features"]).coalesce(1)
    monkeypatch.setattr(packed, "SPREAD", 1)
    data = packed.pack(df, None, "label", "weight", "features")
    files = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")) for f in data.blocks.inputFiles()]
    groups = [f.metadata.row_group(i) for f in files for i in range(f.metadata.num_row_groups)]
    assert len(groups) > 4 and max(g.total_byte_size for g in groups) < 1 << 16  # was one group a file
    assert sum(len(b.label) for b in packed.blocks_of(data.blocks.toArrow().to_batches())) == 4000


def test_a_part_holds_a_bounded_number_of_entries(spark, monkeypatch):
    monkeypatch.setattr(packed, "PART_BYTES", 12 * 100)
    df = spark.createDataFrame([(i, i % 2, 1.0, Vectors.sparse(3, [0, 1], [i + 0.25, 1.0])) for i in range(4000)],
                               ["row_id", "label", "weight", "features"]).coalesce(1)
    assert len(packed.pack(df, None, "label", "weight", "features").blocks.inputFiles()) > 40  # was as many as cores
