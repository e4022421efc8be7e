"""Vector code compression: product codebooks, searched by Orchard's method.

A vector is cut into equal consecutive parts; each part is replaced by the
number of the nearest entry in the codebook of its place.  All arithmetic is
on whole numbers, floor(256 * component), so the same vectors give the same
codebooks and codes in any order and any split into tasks.

The search keeps for every entry the list of all entries by their distance
from it.  It walks the list of the best entry so far, jumps to the list of an
entry that is better, skips entries it has marked as visited, and stops where
the list goes beyond twice the current distance: what follows there is
farther from the vector than the best entry, by the triangle inequality.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

SCALE = 256
#: Vectors searched at once.
BLOCK = 4096


class Codebooks(NamedTuple):
    """``entries[part, entry, position]`` of vectors with ``width`` components (missing ones at the end count as zero)."""
    width: int
    entries: np.ndarray

    def sha256(self) -> str:
        """Digest of all components as decimal numbers, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def kept(vector: Column) -> Column:
    """True for vectors with components, none of them NULL, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def whole_numbers(lists: pa.ListArray, parts: int) -> np.ndarray:
    """floor(256 * x) of all components, as (vector, part, position).

    Numbers are clipped where the squared distance of two vectors could
    outgrow 64 bits (with 64 components at +-2^27, a component of +-2^19).
    """
    v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    largest = math.isqrt((1 << 60) // max(v.shape[1], 1))
    with np.errstate(over="ignore"):
        out = np.clip(np.floor(v * SCALE), -largest, largest).astype(np.int64)
    return np.pad(out, ((0, 0), (0, -out.shape[1] % parts))).reshape(len(lists), parts, -1)


class Lists(NamedTuple):
    """Entries of all parts one after the other, and for each the entries of its part by distance, ties by number.

    ``quarter`` is a quarter of the squared distance less one: a list goes on
    while it is below the squared distance of the best entry.
    """
    entries: np.ndarray
    order: np.ndarray
    quarter: np.ndarray


def neighbour_lists(entries: np.ndarray) -> Lists:
    parts, n, width = entries.shape
    distance = np.stack([((e[:, None, :] - e[None, :, :]) ** 2).sum(axis=2) for e in entries]).reshape(parts * n, n)
    order = np.argsort(distance, axis=1, kind="stable")
    base = np.repeat(np.arange(parts) * n, n)[:, None]
    return Lists(entries.reshape(parts * n, width), order + base, (np.take_along_axis(distance, order, axis=1) - 1) >> 2)


def search(points: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """Of points (vector, part, position): the number of the nearest entry (the lowest of ties) and the squared distance."""
    n, parts, width = points.shape
    size = lists.order.shape[1]
    q = points.reshape(n * parts, width)
    # any first entry will do: the one whose first component is nearest saves most of the walk
    best = np.empty((n, parts), dtype=np.int64)
    for part in range(parts):
        first = lists.entries[part * size:(part + 1) * size, 0]
        order = np.argsort(first, kind="stable")
        middle = (first[order][1:] + first[order][:-1]) / 2
        best[:, part] = order[np.searchsorted(middle, points[:, part, 0])] + part * size
    best = best.ravel()
    d = ((q - lists.entries[best]) ** 2).sum(axis=1)
    visited = np.zeros((len(q), size), dtype=bool)
    visited[np.arange(len(q)), best % size] = True
    place = np.zeros(len(q), dtype=np.int64)
    active = np.arange(len(q))
    while True:
        at = place[active]
        going = at < size
        going[going] = lists.quarter[best[active[going]], at[going]] < d[active[going]]
        active, at = active[going], at[going]
        if not len(active):
            return best.reshape(n, parts) % size, d.reshape(n, parts)
        candidate = lists.order[best[active], at]
        place[active] = at + 1
        new = ~visited[active, candidate % size]
        rows, candidate = active[new], candidate[new]
        visited[rows, candidate % size] = True
        away = ((q[rows] - lists.entries[candidate]) ** 2).sum(axis=1)
        better = (away < d[rows]) | ((away == d[rows]) & (candidate < best[rows]))
        rows = rows[better]
        best[rows], d[rows], place[rows] = candidate[better], away[better], 0


def _usable(vectors: DataFrame, vector_col: str, width: int) -> DataFrame:
    vector = F.col(f"`{vector_col}`")
    return vectors.where(kept(vector) & (F.size(vector) == width))


def _round(vectors: DataFrame, vector_col: str, books: Codebooks) -> Codebooks:
    """Every entry replaced by the floor of the mean of the parts that are nearest to it; entries without parts stay."""
    held = vectors.sparkSession.sparkContext.broadcast(neighbour_lists(books.entries))
    parts, n, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * n, width), dtype=np.int64), np.zeros(parts * n, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                points = whole_numbers(batch.column(0).slice(at, BLOCK), parts)
                slot = (search(points, held.value)[0] + np.arange(parts) * n).ravel()
                counts += np.bincount(slot, minlength=parts * n)
                np.add.at(sums, slot, points.reshape(-1, width))
        used = np.flatnonzero(counts)
        slots = np.repeat(used, width)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.tile(np.arange(width), len(used))),
                                          pa.array(counts[slots]), pa.array(sums[used].ravel())], names=["slot", "position", "n", "total"])

    rows = vectors.select(F.col(f"`{vector_col}`").alias("v")).mapInArrow(run, "slot long, position long, n long, total long")
    merged = rows.groupBy("slot", "position").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    entries = books.entries.reshape(parts * n, width).copy()
    for r in merged.collect():  # a row per entry and position of the codebooks
        entries[r.slot, r.position] = int(r.total) // r.n
    return Codebooks(books.width, entries.reshape(parts, n, width))


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64,
        rounds: int = 2) -> Codebooks:
    """Codebooks of ``entries`` entries (at most 256) for each of ``parts`` parts.

    They start as the parts of the vectors with the smallest ids (NULL last,
    equal ids by their vectors) and move ``rounds`` times to the means of
    what is nearest to them.  Rows with a vector that is NULL, empty, holds
    NULL or non-finite components, or has another length than the one of the
    smallest id are left out.  Huge components are clipped (``whole_numbers``).  Fewer
    vectors than entries give fewer entries, none give none.
    """
    vector = F.col(f"`{vector_col}`")
    good = vectors.where(kept(vector)).select(F.col(f"`{id_col}`").alias("id"), vector.alias("v"))
    lead = good.orderBy(F.asc_nulls_last("id"), "v").select("v").first()
    if lead is None:
        return Codebooks(0, np.zeros((parts, 0, 0), dtype=np.int64))
    width = len(lead.v)
    first = good.where(F.size("v") == width).orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    points = whole_numbers(pa.array([list(map(float, r.v)) for r in first], pa.list_(pa.float64())), parts)
    books = Codebooks(width, np.ascontiguousarray(points.transpose(1, 0, 2)))
    usable = _usable(vectors, vector_col, width)
    for _ in range(rounds):
        books = _round(usable, vector_col, books)
    return books


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding") -> DataFrame:
    """The rows that ``fit`` takes, with ``code`` (two hex digits a part) and ``error`` (squared distance, in 256ths) for the vector.

    All other columns are handed through but those of these two names.
    """
    parts, n, _ = books.entries.shape
    gone = {"code", "error", vector_col.lower()}
    others = [c for c in vectors.columns if c.lower() not in gone]
    rows = _usable(vectors, vector_col, books.width if n else -1).select(
        *[F.col(f"`{c}`") for c in others], F.col(f"`{vector_col}`"))
    fields = [*rows.schema.fields[:-1], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    held = vectors.sparkSession.sparkContext.broadcast(neighbour_lists(books.entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                found, d = search(whole_numbers(batch.column(len(others)), parts), held.value)
                text = found.astype(np.uint8).tobytes().hex()
                code = [text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code, pa.string()), pa.array(d.sum(axis=1))],
                                                 names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def decode(coded: DataFrame, books: Codebooks, code_col: str = "code", vector_col: str = "decoded") -> DataFrame:
    """``coded`` with the vectors that its codes stand for (the middle of each entry's 256th; NULL codes: NULL)."""
    held = coded.sparkSession.sparkContext.broadcast(((books.entries + 0.5) / SCALE).astype(np.float32))
    keep = [i for i, c in enumerate(coded.columns) if c.lower() != vector_col.lower()]
    fields = [coded.schema.fields[i] for i in keep] + [T.StructField(vector_col, T.ArrayType(T.FloatType()))]
    at, parts = coded.columns.index(code_col), books.entries.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if c is None else held.value[np.arange(parts), list(bytes.fromhex(c))].ravel()[:books.width]
                   for c in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(out, pa.list_(pa.float32()))],
                                             names=[f.name for f in fields])

    return coded.mapInArrow(run, T.StructType(fields))


def with_group_error(coded: DataFrame, group_col: str = "label", into: str = "label_error") -> DataFrame:
    """``coded`` (staged) with the error summed over all rows of its group; NULLs are a group.

    Errors are summed per task first, so that a group of a third of all rows is a few numbers.
    """
    of_total = free_name(coded.columns, "group_of_total")
    total = coded.groupBy(F.col(f"`{group_col}`").alias(of_total)).agg(F.sum("error").alias(into))
    return coded.drop(into).join(total, F.col(f"`{group_col}`").eqNullSafe(F.col(of_total)), "left").drop(of_total)
