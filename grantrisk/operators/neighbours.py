"""Nearest neighbours of rows among reference rows: exact or to a stated recall, dense or sparse.

References belong to the cell of their nearest pivot and, inside it, to a
ring of distances from that pivot; a ring of too many rows is dealt out in
parts.  Pivots, rings and counts are small tables; vectors only move by
shuffles.  Rings lie on shelves of about SHELF_BYTES of references: a query is
sent to a shelf once, with the list of the parts that it visits there, and a
task holds one shelf and one chunk of queries.

* Exact: a query searches the nearest ring first.  Its k-th distance then
  bounds the rings that can hold anything nearer (triangle inequality), and
  it is sent to those alone.
* To a recall: a query is sent to the cells of its nearest pivots.  How many
  is read off a sample of queries, whose true neighbours are found exactly:
  the fewest cells that hold the wanted share of them.  Queries times cells
  plus references is all that is shuffled.

Sparse rows (Spark ML vectors) stay lists of indices and values.  A part's
rows are turned into inverted lists, a list of (row, value) per index, whose
products give all squared distances up to rounding; the few rows that can be
among the k nearest are then summed index by index in ascending order, so
the result equals that on the same rows written out.
"""

from __future__ import annotations

import math
import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantrisk.session import cut_lineage

# Functions that run in Python workers are pickled by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a chunk of queries; cells at most; rows of the sample that fits the number of cells to a recall.
QUERY_ROWS, MAX_PIVOTS, RECALL_SAMPLE = 1 << 16, 1024, 200
#: Pairs of rows whose distances a task holds at a time; bytes of references of a shelf; queries that make a chunk worth a task.
PAIRS, SHELF_BYTES, FEW_QUERIES = 1 << 22, 1 << 23, 256
#: Rows whose distances to all pivots a task holds at a time.
MAPPED_ROWS = 2048
EMPTY = "array<struct<d2: double, id: bigint>>"


class Rows(NamedTuple):
    """Rows of numbers as ``starts``, ``index``, ``value`` (sparse) or as a matrix ``dense``."""
    ids: np.ndarray
    dense: np.ndarray | None = None
    starts: np.ndarray | None = None
    index: np.ndarray | None = None
    value: np.ndarray | None = None

    def norms2(self) -> np.ndarray:
        if self.dense is not None:
            return (self.dense * self.dense).sum(axis=1)
        upto = np.append(0.0, np.cumsum(self.value * self.value))
        return upto[self.starts[1:]] - upto[self.starts[:-1]]

    def pick(self, rows: np.ndarray) -> Rows:
        if self.dense is not None:
            return Rows(self.ids[rows], self.dense[rows])
        sizes = self.starts[rows + 1] - self.starts[rows]
        starts = np.append(0, np.cumsum(sizes))
        at = np.repeat(self.starts[rows] - starts[:-1], sizes) + np.arange(starts[-1])
        return Rows(self.ids[rows], None, starts, self.index[at], self.value[at])

    def take(self, rows: slice) -> Rows:
        if self.dense is not None:
            return Rows(self.ids[rows], self.dense[rows])
        starts = self.starts[rows.start:rows.stop + 1]
        part = slice(starts[0], starts[-1])
        return Rows(self.ids[rows], None, starts - starts[0], self.index[part], self.value[part])


def sparse_columns(vec: str) -> list[Column]:
    """``index`` and ``value`` of the non-zero components of a Spark ML vector, by ascending index."""
    v = F.unwrap_udt(F.col(vec))
    pairs = F.when(v["type"] == 0, F.arrays_zip(v["indices"].alias("i"), v["values"].alias("x"))) \
        .otherwise(F.transform(v["values"], lambda x, i: F.struct(i.alias("i"), x.alias("x"))))
    pairs = F.filter(pairs, lambda p: p["x"] != 0)
    return [F.transform(pairs, lambda p: p["i"]).alias("index"), F.transform(pairs, lambda p: p["x"]).alias("value")]


def rows_of(table: pa.Table | pa.RecordBatch, ids: str) -> Rows:
    """Rows of an Arrow table with a column ``vec`` (lists of one length) or ``index`` and ``value``; NULLs are an error."""
    def column(name: str) -> pa.Array:
        c = table.column(name)
        return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c

    rid = column(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    if "vec" in table.schema.names:
        lists = column("vec")
        widths = lists.value_lengths().to_numpy(zero_copy_only=False)
        bad = np.flatnonzero((widths != widths[0]) | np.isnan(widths.astype(np.float64))) if len(rid) else []
        if len(bad) or lists.flatten().null_count:
            raise ValueError(f"vector of another length or with NULLs, row {rid[bad[0]] if len(bad) else rid[0]}")
        return Rows(rid, lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rid), -1))
    index, value = column("index"), column("value")
    if index.null_count or value.null_count:
        raise ValueError(f"vector NULL, row {rid[np.flatnonzero(index.is_null().to_numpy(zero_copy_only=False))[0]]}")
    starts = np.append(0, np.cumsum(index.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    return Rows(rid, None, starts, index.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False))


def _products(a: Rows, b: Rows) -> np.ndarray:
    """Scalar products of all rows of ``a`` with all of ``b``."""
    if a.dense is not None:
        if a.dense.shape[1] != b.dense.shape[1]:
            raise ValueError(f"vectors of {a.dense.shape[1]} and of {b.dense.shape[1]} components")
        return a.dense @ b.dense.T
    out = np.zeros((len(a.ids), len(b.ids)))
    by_index = [np.argsort(r.index, kind="stable") for r in (a, b)]
    of = [np.repeat(np.arange(len(r.ids)), np.diff(r.starts))[o] for r, o in zip((a, b), by_index)]
    index, value = zip(*[(r.index[o], r.value[o]) for r, o in zip((a, b), by_index)])
    shared = np.intersect1d(index[0], index[1])
    spans = [(np.searchsorted(i, shared), np.searchsorted(i, shared, side="right")) for i in index]
    size = [s[1] - s[0] for s in spans]
    # indices that most rows have: one product of matrices; the others: their lists against each other
    full = np.flatnonzero((size[0] * 2 > len(a.ids)) & (size[1] * 2 > len(b.ids)))
    if len(full):
        matrices = []
        for r, i, v, o, (s, e) in zip((a, b), index, value, of, spans):
            m = np.zeros((len(r.ids), len(full)))
            for k, f in enumerate(full):
                m[o[s[f]:e[f]], k] = v[s[f]:e[f]]
            matrices.append(m)
        out += matrices[0] @ matrices[1].T
    for f in np.setdiff1d(np.arange(len(shared)), full):
        (s, e), (t, g) = ((spans[x][0][f], spans[x][1][f]) for x in (0, 1))
        out[of[0][s:e, None], of[1][None, t:g]] += value[0][s:e, None] * value[1][None, t:g]
    return out


def distances(a: Rows, b: Rows) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all of ``b``, up to rounding."""
    return np.sqrt(np.maximum(a.norms2()[:, None] + b.norms2()[None, :] - 2 * _products(a, b), 0.0))


def _exact(q: Rows, qi: np.ndarray, r: Rows, ri: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (row of ``q``, row of ``r``), summed component by component."""
    total = np.zeros(len(qi))
    if q.dense is not None:
        for x, y in zip(q.dense.T, r.dense.T):
            diff = x[qi] - y[ri]
            total += diff * diff
        return total
    # the components of both rows of a pair, by pair and index: equal neighbours are one component
    pair, index, value = [], [], []
    for rows, some in ((q, qi), (r, ri)):
        sizes = rows.starts[some + 1] - rows.starts[some]
        of = np.repeat(np.arange(len(some)), sizes)
        at = np.repeat(rows.starts[some] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(of))
        pair, index, value = [*pair, of], [*index, rows.index[at]], [*value, rows.value[at]]
    sign = np.repeat([1.0, -1.0], [len(value[0]), len(value[1])])
    pair, index, value = np.concatenate(pair), np.concatenate(index), np.concatenate(value) * sign
    order = np.lexsort((index, pair))
    pair, index, value = pair[order], index[order], value[order]
    again = np.append(False, (pair[1:] == pair[:-1]) & (index[1:] == index[:-1]))
    value[np.flatnonzero(again) - 1] += value[again]
    pair, square = pair[~again], value[~again] ** 2
    np.add.at(total, pair, square)  # one after the other, by ascending index
    return total


def _offsets(sorted_rows: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_rows, np.arange(n + 1)).astype(np.int32)


def _least(row: np.ndarray, d2: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least (distance, id) of each row, by row."""
    order = np.lexsort((ids, d2, row))
    row = row[order]
    first = np.searchsorted(row, row)
    few = np.arange(len(row)) - first < k
    return row[few], d2[order[few]], ids[order[few]]


def nearest(q: Rows, r: Rows, k: int, exclude_self: bool, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of ``r`` for each row of ``q`` by (distance, id): (offsets, squared distances, ids).

    Rows beyond ``bound`` (a distance per query) may be left out.
    """
    row, d2, ids = near_pairs(q, r, k, exclude_self, bound)
    return _offsets(row, len(q.ids)), d2, ids


def near_pairs(q: Rows, r: Rows, k: int, exclude_self: bool, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lists of :func:`nearest` as (row of ``q``, squared distance, id), by row."""
    kk = min(k, len(r.ids))
    parts = [(np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64))]
    qn, rn = q.norms2(), r.norms2()
    step = max(1, int(PAIRS // max(1, len(r.ids))))
    for lo in range(0, len(q.ids) if kk else 0, step):
        hi = min(len(q.ids), lo + step)
        d2 = _products(q.take(slice(lo, hi)), r)
        d2 *= -2
        d2 += qn[lo:hi, None]
        d2 += rn[None, :]
        # what rounding may have moved, at most
        slack = 1e-12 * (qn[lo:hi] + rn.max()) + 1e-300
        if exclude_self:
            d2[q.ids[lo:hi, None] == r.ids[None, :]] = np.inf
        limit = np.full(hi - lo, np.inf)
        if bound is not None:
            limit = bound[lo:hi] ** 2 * (1 + 1e-9) + 2 * slack
        # rows with more than k left within their bound are cut at their k-th distance
        many = np.flatnonzero((d2 <= limit[:, None]).sum(axis=1) > kk)
        if len(many):
            limit[many] = np.minimum(limit[many], np.partition(d2[many], kk - 1, axis=1)[:, kk - 1] + 2 * slack[many])
        rows, some = np.nonzero((d2 <= limit[:, None]) & (d2 < np.inf))
        del d2
        # ties can make these any number: as many at a time as there are pairs in a block
        ends = _offsets(rows, hi - lo)
        at = 0
        while at < hi - lo:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PAIRS // 8, side="right")) - 1)
            span = slice(ends[at], ends[to])
            parts.append(_least(lo + rows[span], _exact(q, lo + rows[span], r, some[span]), r.ids[some[span]], k))
            at = to
    return tuple(np.concatenate(x) for x in zip(*parts))


class Cells(NamedTuple):
    """Pivots, and per ring its cell, inner and outer radius, number of parts and of rows."""
    pivots: Rows
    cell: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    parts: np.ndarray
    rows: np.ndarray

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each ring's first piece, and of every piece, a part of a ring, the ring and the shelf.

        A shelf is the pieces that a task searches, together about SHELF_BYTES.
        """
        p = self.pivots
        width = 8 * p.dense.shape[1] if p.dense is not None else 0 if p.index is None else 12 * len(p.index) / max(1, len(p.ids))
        first = np.cumsum(self.parts) - self.parts
        ring = np.repeat(np.arange(len(self.parts)), self.parts)
        size = (self.rows / self.parts)[ring]
        shelf = ((np.cumsum(size) - size) // max(1, SHELF_BYTES // (width + 48))).astype(np.int64)
        return first, ring, np.unique(shelf, return_inverse=True)[1].astype(np.int32)

    def slack(self) -> float:
        """What rounding may move a distance by, generously."""
        return 1e-6 * (1 + math.sqrt(float(self.pivots.norms2().max(initial=0.0))) + float(self.outer.max(initial=0.0)))


def _mapped(df: DataFrame, ids: str, extra: str, work) -> DataFrame:
    """``df`` with columns ``extra`` made by ``work(rows, batch)``, arrays per batch."""
    names = df.columns + [c.split()[0] for c in extra.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, MAPPED_ROWS):
                batch = whole.slice(at, MAPPED_ROWS)
                yield pa.RecordBatch.from_arrays([*batch.columns, *work(rows_of(batch, ids), batch)], names=names)

    return df.mapInArrow(run, f"{schema}, {extra}")


def build_cells(refs: DataFrame, block_rows: int) -> tuple[DataFrame, Cells]:
    """References with their ring and part (checkpointed), and the cells: as many as there would be blocks, MAX_PIVOTS at most."""
    n = refs.count()
    wanted = min(MAX_PIVOTS, math.ceil(n / block_rows))
    pivots = rows_of(refs.orderBy(F.xxhash64("rid"), "rid").limit(wanted).toArrow(), "rid")
    sc = refs.sparkSession.sparkContext
    held = sc.broadcast(pivots)

    def assign(rows: Rows, _) -> list[pa.Array]:
        d = distances(rows, held.value)
        return [pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))]

    placed = cut_lineage(_mapped(refs, "rid", "cell int, own double", assign))
    # rings of about block_rows rows: cut at quantiles of the distance, as many cuts as there are blocks of references
    cuts = {}
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("own", [i / 64 for i in range(1, 64)], 1000).alias("q")).collect():
        rings = min(64, math.ceil(r.n / block_rows))
        cuts[r.cell] = sorted({r.q[round(i * 64 / rings) - 1] for i in range(1, rings)})
    table = F.lit([[float("-inf"), *cuts.get(c, [])] for c in range(len(pivots.ids))])
    ring = F.size(F.filter(F.element_at(table, F.col("cell") + 1), lambda x: x < F.col("own"))) - 1
    placed = placed.withColumn("ring", ring)
    stats = sorted(placed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("own").alias("lo"), F.max("own").alias("hi")).collect())
    number = {(s.cell, s.ring): i for i, s in enumerate(stats)}
    parts = np.array([math.ceil(s.n / block_rows) for s in stats], dtype=np.int32)
    first = F.element_at(F.lit([number.get((c, 0), 0) for c in range(len(pivots.ids))]), F.col("cell") + 1)
    place = placed.withColumn("block", (first + F.col("ring")).cast("int"))
    part = F.pmod(F.xxhash64("rid"), F.element_at(F.lit(parts.tolist()), F.col("block") + 1)).cast("int")
    cells = Cells(pivots, np.array([s.cell for s in stats]), np.array([s.lo for s in stats]), np.array([s.hi for s in stats]), parts, np.array([s.n for s in stats]))
    return place.withColumn("part", part).drop("own", "ring"), cells


def _visits(cells: Cells, d: np.ndarray) -> np.ndarray:
    """Least distance of each query to anything in each ring, from its distances to the pivots."""
    to = d[:, cells.cell]
    return np.maximum(np.maximum(cells.inner[None, :] - to, to - cells.outer[None, :]), 0.0)


def _listed(cells: Cells, near: np.ndarray) -> list[pa.Array]:
    """Per query the shelves that hold pieces of its rings ``near`` (queries x rings), each with these pieces."""
    _, ring, shelf = cells.pieces()
    row, piece = np.nonzero(near[:, ring])
    on = shelf[piece]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (on[1:] != on[:-1]))) if len(row) else np.empty(0, dtype=np.int64)
    pieces = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), pa.array(piece.astype(np.int32)))
    visits = pa.StructArray.from_arrays([pa.array(on[new]), pieces], names=["shelf", "pieces"])
    return [pa.ListArray.from_arrays(pa.array(np.searchsorted(row[new], np.arange(len(near) + 1)), pa.int32()), visits)]


VISITS = "visits array<struct<shelf:int,pieces:array<int>>>"


def _on_shelf(q: Rows, wanted: pa.Array, bound: np.ndarray, r: Rows, piece: np.ndarray, k: int, exclude_self: bool):
    """The k nearest of each query row among the pieces that it lists, a piece at a time: (row, squared distance, id)."""
    of = np.repeat(np.arange(len(q.ids)), wanted.value_lengths().to_numpy(zero_copy_only=False))
    lists = wanted.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(lists, kind="stable")
    of, lists = of[order], lists[order]
    by_piece = np.argsort(piece, kind="stable")
    r, piece = r.pick(by_piece), piece[by_piece]
    found, held = [(np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64))], 0
    for p in np.unique(piece):
        some = of[np.searchsorted(lists, p):np.searchsorted(lists, p, side="right")]
        if not len(some):
            continue
        refs = r.take(slice(*np.searchsorted(piece, [p, p + 1])))
        row, d2, ids = near_pairs(q.pick(some), refs, k, exclude_self, bound[some])
        found.append((some[row], d2, ids))
        held += len(row)
        if held > PAIRS // 16:
            found = [_least(*map(np.concatenate, zip(*found)), k)]
            row, held = found[0][0], 0
            last = np.flatnonzero(np.bincount(row, minlength=len(q.ids)) == k)  # rows with k: none beyond their k-th counts
            bound[last] = np.minimum(bound[last], np.sqrt(found[0][1][np.searchsorted(row, last, side="right") - 1]))
    return _least(*map(np.concatenate, zip(*found)), k)


def _search(q: DataFrame, r: DataFrame, cells: Cells, k: int, exclude_self: bool, columns: list[str]) -> DataFrame:
    """(qid, nn) of every query row (qid, vector, bound, visits) against all rows of the pieces that it visits, a list per shelf."""
    first, _, shelf = cells.pieces()
    q = q.select("qid", *columns, "bound", F.inline("visits"))
    n = {x.shelf: x.n for x in q.groupBy("shelf").agg(F.count("*").alias("n")).collect()}
    # no task has more than QUERY_ROWS queries, and small searches are dealt out to all cores
    spread = math.ceil(2 * q.sparkSession.sparkContext.defaultParallelism / max(1, len(n)))
    chunks = [max(1, math.ceil(n.get(x, 0) / QUERY_ROWS), min(spread, n.get(x, 0) // FEW_QUERIES)) for x in range(shelf[-1] + 1)]
    chunks_of = F.element_at(F.lit(chunks), F.col("shelf") + 1)
    q = q.withColumn("chunk", F.pmod(F.xxhash64("qid"), chunks_of).cast("int"))
    r = r.withColumn("piece", F.element_at(F.lit(first.tolist()), F.col("block") + 1) + F.col("part"))
    r = r.withColumn("shelf", F.element_at(F.lit(shelf.tolist()), F.col("piece").cast("int") + 1))
    r = r.select("rid", *columns, F.col("piece").cast("int"), F.col("shelf").cast("int"))
    if len(cells.cell) > 1:
        seen = sorted(n)  # shelves that no query visits stay where they are
        r = r.where(F.col("shelf").isin(seen)) if len(seen) <= shelf[-1] else r
    r = r.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks_of - 1)))
    struct = pa.struct([("d2", pa.float64()), ("id", pa.int64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "nn": pa.array([], pa.list_(struct))})
        queries = rows_of(left, "qid")
        row, d2, ids = _on_shelf(queries, left.column("pieces").combine_chunks(), left.column("bound").to_numpy().copy(),
                                 rows_of(right, "rid"), right.column("piece").to_numpy(), k, exclude_self)
        values = pa.StructArray.from_arrays([pa.array(d2), pa.array(ids)], fields=list(struct))
        return pa.table({"qid": pa.array(queries.ids), "nn": pa.ListArray.from_arrays(pa.array(_offsets(row, len(queries.ids))), values)})

    key = ["shelf", "chunk"]
    return q.groupBy(*key).cogroup(r.groupBy(*key)).applyInArrow(score, f"qid bigint, nn {EMPTY}")


def best(lists: DataFrame, k: int) -> DataFrame:
    """The k least of all lists of a query."""
    return lists.groupBy("qid").agg(F.flatten(F.collect_list("nn")).alias("nn")).select("qid", F.slice(F.array_sort("nn"), 1, k).alias("nn"))


def exact(queries: DataFrame, refs: DataFrame, cells: Cells, k: int, exclude_self: bool, columns: list[str]) -> DataFrame:
    """(qid, nn): the k nearest references of all queries (qid, vector); both checkpointed."""
    held = queries.sparkSession.sparkContext.broadcast(cells)
    rings = len(cells.cell)

    def home(rows: Rows, _) -> list[pa.Array]:
        near, block = np.zeros((len(rows.ids), rings), dtype=bool), []
        for d in _in_steps(rows, held.value):
            block.append(np.argmin(_visits(held.value, d) + 1e-9 * d[:, held.value.cell], axis=1))
        block = np.concatenate(block).astype(np.int32)
        near[np.arange(len(near)), block] = True
        return [pa.array(block), *_listed(held.value, near)]

    q = cut_lineage(_mapped(queries, "qid", f"home int, {VISITS}", home))
    first = cut_lineage(best(_search(q.withColumn("bound", F.lit(float("inf"))), refs, cells, k, exclude_self, columns), k))
    bound = F.when(F.size("nn") == k, F.sqrt(F.col("nn")[k - 1]["d2"])).otherwise(F.lit(float("inf")))
    bounded = q.drop("visits").join(first.select(F.col("qid").alias("of"), bound.alias("bound")), F.col("qid") == F.col("of"), "left").drop("of") \
        .withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def reach(rows: Rows, batch: pa.RecordBatch) -> list[pa.Array]:
        slack, at = held.value.slack(), 0
        homes, bounds = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("home", "bound"))
        near = np.zeros((len(rows.ids), rings), dtype=bool)
        for d in _in_steps(rows, held.value):
            near[at:at + len(d)] = _visits(held.value, d) <= bounds[at:at + len(d), None] + slack
            at += len(d)
        near[np.arange(len(near)), homes] = False
        return _listed(held.value, near)

    rest = cut_lineage(_mapped(bounded, "qid", VISITS, reach))
    return best(first.unionByName(_search(rest, refs, cells, k, exclude_self, columns)), k)


def _in_steps(rows: Rows, cells: Cells):
    """Distances of the rows to the pivots, as many rows at a time as PAIRS allows for the rings."""
    step = max(1, PAIRS // 2 // max(1, len(cells.cell)))
    for at in range(0, len(rows.ids), step):
        yield distances(rows.take(slice(at, min(len(rows.ids), at + step))), cells.pivots)


def probes_for(queries: DataFrame, refs: DataFrame, cells: Cells, k: int, exclude_self: bool, columns: list[str], recall: float) -> int:
    """The fewest nearest cells that hold ``recall`` of the true neighbours of a sample of RECALL_SAMPLE queries."""
    sample = cut_lineage(queries.orderBy(F.xxhash64("qid"), "qid").limit(RECALL_SAMPLE))
    true = exact(sample, refs, cells, k, exclude_self, columns).select("qid", F.explode("nn.id").alias("rid"))
    where = true.join(refs.select("rid", "cell"), "rid").select("qid", "cell").toPandas()  # k rows a sampled query
    if not len(where):
        return 1
    rows = rows_of(sample.toArrow(), "qid")
    order = np.argsort(distances(rows, cells.pivots), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    at = {q: i for i, q in enumerate(rows.ids.tolist())}
    found = np.sort([rank[at[q], c] for q, c in zip(where["qid"], where["cell"])])
    return int(found[min(len(found) - 1, math.ceil(min(recall, 1.0) * len(found)) - 1)]) + 1


def approximate(queries: DataFrame, refs: DataFrame, cells: Cells, k: int, exclude_self: bool, columns: list[str], probes: int) -> DataFrame:
    """(qid, nn): the k nearest references of all queries within the cells of their ``probes`` nearest pivots."""
    held = queries.sparkSession.sparkContext.broadcast(cells)

    def visit(rows: Rows, _) -> list[pa.Array]:
        d = distances(rows, held.value.pivots)
        ranked = np.argsort(d, axis=1, kind="stable")[:, :probes]
        chosen = np.zeros(d.shape, dtype=bool)
        chosen[np.arange(len(d))[:, None], ranked] = True
        return _listed(held.value, chosen[:, held.value.cell])

    q = cut_lineage(_mapped(queries, "qid", VISITS, visit))
    return best(_search(q.withColumn("bound", F.lit(float("inf"))), refs, cells, k, exclude_self, columns), k)


def search(q: DataFrame, r: DataFrame, k: int, exclude_self: bool, block_rows: int, recall: float | None = None) -> DataFrame:
    """(qid, nn) of rows (qid, vec) or (qid, index, value) among rows (rid, ...) of the same form.

    ``recall`` None: exact.  Otherwise the share of true neighbours wanted,
    which a sample of the queries meets exactly and all of them about.
    """
    columns = [c for c in q.columns if c != "qid"]
    if r.count() <= block_rows:  # one part, which every query meets: nothing to place and nothing to bound
        one = Cells(Rows(np.zeros(1, np.int64)), np.zeros(1, np.int32), np.zeros(1), np.zeros(1), np.ones(1, np.int32), np.ones(1))
        whole = F.array(F.struct(F.lit(0).alias("shelf"), F.array(F.lit(0)).alias("pieces")))
        return _search(q.withColumns({"bound": F.lit(float("inf")), "visits": whole}),
                       r.withColumns({"block": F.lit(0), "part": F.lit(0)}), one, k, exclude_self, columns)
    refs, cells = build_cells(r, block_rows)
    q = cut_lineage(q)
    if recall is None:
        return exact(q, refs, cells, k, exclude_self, columns)
    return approximate(q, refs, cells, k, exclude_self, columns, probes_for(q, refs, cells, k, exclude_self, columns, recall))
