"""Embedding near-dedup with a pivot-permutation index.

Reference points (pivots) are chosen from a bounded sample so that no two are
alike.  A vector is described by its nearest pivots in order of distance; the
index lists vectors under each pair of pivots that they share a place with,
so two vectors meet exactly when at least two of their nearest pivots are
shared.  Where vectors meet, cosines are verified in double precision.  A
pair that meets in several lists counts in the first of them only.

Equal vectors of a label are one entry.  A list that very many vectors share
is split into blocks.  Tasks hand on counts of links per vector and the links
as a forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, forest, in_blocks, sorted_groups, staged

#: Nearest pivots that describe a vector; two shared ones make a candidate.
NEAREST = 5
MIN_PIVOTS = 128
MAX_PIVOTS = 8192
#: Sampled vectors per pivot wanted, and the cosine above which two of them are too alike to be both pivots.
SAMPLE = 4
ALIKE = 0.5
#: A list with more vectors than this is split into blocks.
BLOCK = 1024


def usable(vector: Column, label: Column) -> Column:
    """True for vectors that can link: a label, components without NULL, NaN and infinity, and one that isn't 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.ListArray) -> np.ndarray:
    """Rows of doubles from lists of equal length."""
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _units(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; huge and tiny ones are brought near 1 first, so that no square overflows or vanishes."""
    v = v / 2.0 ** np.frexp(np.abs(v).max(axis=1, keepdims=True, initial=0.0))[1]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _fit(pivots: np.ndarray, width: int) -> np.ndarray:
    """Pivots cut or filled with zeros to ``width``; only vectors of one length are ever compared, by the same pivots."""
    return pivots[:, :width] if width <= pivots.shape[1] else np.pad(pivots, ((0, 0), (0, width - pivots.shape[1])))


def choose_pivots(entries: DataFrame, wanted: int) -> np.ndarray:
    """Up to ``wanted`` unit vectors, none alike, from the SAMPLE * wanted entries that come first in hash order."""
    rows = entries.orderBy(F.xxhash64("vector"), "entry").limit(SAMPLE * wanted).select("vector").collect()
    width = max((len(r.vector) for r in rows), default=1)
    pivots = np.zeros((0, width))
    for r in rows:
        v = np.zeros(width)
        v[:len(r.vector)] = r.vector
        v = _units(v[None, :])[0]
        if len(pivots) < wanted and (not len(pivots) or (pivots @ v).max() < ALIKE):
            pivots = np.vstack([pivots, v])
    return pivots


def describe(entries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``entries`` with ``near``: the numbers of their nearest pivots, nearest first."""
    held = entries.sparkSession.sparkContext.broadcast(pivots)
    at, names = entries.columns.index("vector"), [*entries.columns, "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            widths = lists.value_lengths().to_numpy()
            near = np.zeros((batch.num_rows, min(NEAREST, len(held.value))), dtype=np.int32)
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                cosines = _units(_vectors(lists.take(pa.array(rows)))) @ _fit(held.value, width).T
                near[rows] = np.argsort(-cosines, axis=1, kind="stable")[:, :near.shape[1]]
            column = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), near.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema.fields)
    return entries.mapInArrow(run, f"{schema}, near array<int>")


def _listed(described: DataFrame, n_pivots: int) -> DataFrame:
    """A row per vector and pair of its nearest pivots: ``list`` is the pair, ``place`` the vector's label and length."""
    ordered = F.sort_array("near")
    if n_pivots < 2:  # a lone pivot: one list of all vectors of a place
        pairs = F.array(F.lit(0).cast("long"))
    else:
        picks = [(i, j) for j in range(1, min(NEAREST, n_pivots)) for i in range(j)]
        pairs = F.array(*[ordered[i].cast("long") * F.lit(1 << 20) + ordered[j] for i, j in picks])
    place = F.xxhash64("label", F.size("vector"))
    return described.select("entry", "copies", "label", "vector", ordered.alias("near"), place.alias("place"), F.explode(pairs).alias("list"))


def links(entries: DataFrame, at_least: float, pivots: int | None = None) -> DataFrame:
    """(a, b, n): rows with b NULL say that entry a links with n vectors; the others are a forest of the links.

    ``entries``: (entry, label, vector, copies), staged and usable.  The
    number of pivots grows with the root of the number of entries, within
    MIN_PIVOTS and MAX_PIVOTS, so that lists stay short.
    """
    wanted = pivots or int(min(max(MIN_PIVOTS, (entries.count() / 3) ** 0.5), MAX_PIVOTS))
    chosen = choose_pivots(entries, wanted)
    if not len(chosen):
        return entries.select(F.col("entry").alias("a"), F.col("entry").alias("b"), F.lit(0).cast("long").alias("n")).limit(0)
    described = staged(describe(entries, chosen), "described")
    rows = in_blocks(_listed(described, len(chosen)), ["place", "list"], "entry", BLOCK)
    columns = ["place", "list", "pair", "block", "entry", "copies", "label", "near", "vector"]
    rows = rows.select(*columns).repartition("place", "list", "pair").sortWithinPartitions("place", "list", "pair")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in sorted_groups(batches, columns[:3]):
            if len(starts) == 1 or starts[-1] != batch.num_rows:
                starts = np.append(starts, batch.num_rows)
            which, pair, block, entry, copies = (batch.column(i).to_numpy() for i in range(1, 6))
            out = []
            for s, e in zip(starts[:-1], starts[1:]):
                if e - s < 2:
                    continue
                part = batch.slice(s, e - s)
                if len(set(part.column(6).to_pylist())) > 1 or len(set(part.column(8).value_lengths().to_pylist())) > 1:
                    raise ValueError("two places share a hash")
                unit = _units(_vectors(part.column(8)))
                close = unit @ unit.T >= at_least
                np.fill_diagonal(close, False)
                if pair[s] >> 31 != pair[s] & (1 << 31) - 1:
                    close &= block[s:e, None] != block[None, s:e]
                if not close.any():
                    continue
                # Count a pair in its first list: no smaller pair of shared pivots exists than this list's.
                near = np.stack(part.column(7).to_numpy(zero_copy_only=False))
                low, high = which[s] >> 20, which[s] & (1 << 20) - 1
                before = np.unique(near[(near < high) & (near != low)])
                if len(before):
                    has = (near[:, :, None] == before[None, None, :]).any(axis=1).astype(np.float32)
                    close &= has @ has.T == 0
                a, b = np.nonzero(close)
                if len(a):
                    n = close @ copies[s:e]
                    linked = n > 0
                    out.append((entry[s:e][linked], n[linked], *forest(entry[s:e][a], entry[s:e][b])))
            if out:
                one, n, below, root = map(np.concatenate, zip(*out))
                ones, at = np.unique(one, return_inverse=True)
                total = np.zeros(len(ones), dtype=np.int64)
                np.add.at(total, at, n)
                below, root = forest(below, root)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([ones, below])),
                    pa.array(np.concatenate([np.zeros_like(ones), root]), mask=np.arange(len(ones) + len(below)) < len(ones)),
                    pa.array(np.concatenate([total, np.zeros(len(below), dtype=np.int64)]))], names=["a", "b", "n"])

    return rows.mapInArrow(verify, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, at_least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors of one label and length link at a cosine of ``at_least`` or more;
    rows with equal vectors and labels link, whatever their ids.  Vectors
    that can't link (NULL, empty, zero, with NULL or non-finite components,
    or without a label) have no links and are their own component.
    ``component_id`` is the smallest id that links reach, ``kept`` whether
    the row's own id is that.  An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("usable", usable(F.col("vector"), F.col("label")))
    key = [F.when(F.col("usable"), F.xxhash64(F.lit(seed), "vector")).alias(name) for seed, name in ((1, "k1"), (2, "k2"))]
    slim = staged(rows.select("vec_id", "label", "usable", *key), "vectors")
    same = rows.where("usable").select("*", *key).groupBy("label", "k1", "k2")
    entries = staged(same.agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
                     .withColumn("entry", F.monotonically_increasing_id()), "entries")
    found = staged(links(entries.select("entry", "label", "vector", "copies"), at_least, pivots), "vector-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    trees = components(found.where("b is not null"))
    known = entries.select("label", "k1", "k2", "entry", "first", "copies") \
        .join(counts, F.col("entry") == F.col("a"), "left").join(trees, F.col("entry") == F.col("node"), "left") \
        .withColumn("tree", F.coalesce("component", "entry"))
    least = known.groupBy("tree").agg(F.min("first").alias("component_id"))
    known = known.join(least, "tree").select(
        F.col("label").alias("l"), F.col("k1").alias("x1"), F.col("k2").alias("x2"), "component_id",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = staged(known, "vector-groups")
    out = slim.join(known, (F.col("label") == F.col("l")) & (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2")), "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      component.eqNullSafe(F.col("vec_id")).alias("kept"))
