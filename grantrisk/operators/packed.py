"""Labelled sparse rows packed into blocks, for learners that pass over them many times.

A block is one row of binary columns: a few thousand rows' folds, labels and
weights, and their non-zero components in two parts.  Columns that many rows
have (*hot* ones) become a small dense matrix when a block is read, the others
stay lists of (row, column, value).  Values are written only where they aren't
1, positions only where a column has gaps.  Row groups are small: a reader
holds one of them.  Rows are shuffled by their last column
that is not hot and sorted by it, so a task meets its own few of the many
columns of a wide one-hot matrix: what it returns of a gradient is the columns
that it met, and all tasks' returns together are about as wide as the matrix.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantrisk.operators.neighbours import sparse_columns
from grantrisk.session import cut_lineage

# Functions that run in Python workers are pickled by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Stands for a NULL fold, which no model leaves out.
NO_FOLD = -2
#: A column is hot if one row in HOT has it; components of a block; bytes of unmerged gradients in a task; parts for rows of hot columns only.
HOT, ENTRIES, PENDING, SPREAD = 64, 1 << 16, 1 << 25, 1 << 12
#: Bytes of a row group of blocks, and of the packed rows of a part.
GROUP_BYTES, PART_BYTES = 1 << 24, 1 << 27
#: full: hot columns that most rows of the block have, as a matrix; one: places of other hot entries of 1; at, value: of the rest; no cold_value: all are 1.
_TYPES = {"fold": np.int32, "label": np.float64, "weight": np.float64, "hot": np.int32, "full": np.int32, "full_value": np.float64, "one": np.int32,
          "at": np.int32, "value": np.float64, "cold_row": np.int32, "cold_column": np.int32, "cold_value": np.float64}
_BINARY = tuple(_TYPES)


class Packed(NamedTuple):
    """The checkpointed blocks, the number of columns and the rows of each fold."""
    blocks: DataFrame
    width: int
    rows: dict[int, int]


class Block(NamedTuple):
    """Rows of one block: the dense part with its columns and the entries of the rest, by row and by column."""
    fold: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    hot: np.ndarray
    dense: np.ndarray
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def products(self, weights: np.ndarray) -> np.ndarray:
        """Rows times ``weights`` (a row per column of the matrix)."""
        out = self.dense @ weights[self.hot]
        if len(self.row):
            first = np.flatnonzero(np.diff(self.row, prepend=-1))
            out[self.row[first]] += np.add.reduceat(self.value[:, None] * weights[self.column], first, axis=0)
        return out

    def sums(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The columns that the block has and the sums over its rows of value times ``rest`` (a row per row) in each."""
        columns, sums = self.hot, self.dense.T @ rest
        if len(self.row):
            order = np.argsort(self.column, kind="stable")
            column = self.column[order]
            first = np.flatnonzero(np.diff(column, prepend=-1))
            cold = np.add.reduceat(self.value[order, None] * rest[self.row[order]], first, axis=0)
            columns, sums = np.concatenate([columns, column[first]]), np.concatenate([sums, cold])
        return columns, sums


class Gradient:
    """Sums of rows by column, merged as they pile up."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, columns: np.ndarray, sums: np.ndarray) -> None:
        self.parts.append((columns, sums))
        self.pending += sums.nbytes
        if self.pending > PENDING:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            columns, at = np.unique(np.concatenate([c for c, _ in self.parts]), return_inverse=True)
            total, lo = np.zeros((len(columns), self.parts[0][1].shape[1])), 0
            for c, s in self.parts:
                total[at[lo:lo + len(c)]] += s  # a part has each column once
                lo += len(c)
            self.parts = [(columns, total)]
        self.pending = 0  # of what is not merged yet
        return self.parts[0] if self.parts else (np.empty(0, np.int32), np.zeros((0, 0)))


def pack(data: DataFrame, fold: str | None, label: str, weight: str | None, features: str) -> Packed:
    """``data`` packed; without ``fold`` all rows have fold 0."""
    one = cut_lineage(data.select(F.coalesce(F.col(fold).cast("int"), F.lit(NO_FOLD)).alias("fold") if fold else F.lit(0).alias("fold"), F.col(label).cast("double").alias("label"),
                                  F.col(weight).cast("double").alias("weight") if weight else F.lit(1.0).alias("weight"), *sparse_columns(features)))
    n = {r["fold"]: r["n"] for r in one.groupBy("fold").agg(F.count("*").alias("n")).collect()}  # a row per fold
    counts = one.select(F.explode("index").alias("column")).groupBy("column").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts)
    width = (counts.agg(F.max("column")).first()[0] or 0) + 1
    # at most HOT times the components of a row are hot
    hot = sorted(r["column"] for r in counts.where(F.col("n") * HOT >= max(1, sum(n.values()))).select("column").collect())
    cold = F.array_max(F.array_except("index", F.lit(hot).cast("array<int>"))) if hot else F.array_max("index")
    key = F.coalesce(cold, -1 - F.pmod(F.xxhash64("index", "value", "label", "fold"), F.lit(SPREAD)).cast("int"))
    entries = counts.agg(F.sum("n")).first()[0] or 0
    parts = max(one.rdd.getNumPartitions(), data.sparkSession.sparkContext.defaultParallelism, 12 * entries // PART_BYTES)
    rows = one.withColumn("key", key).repartition(parts, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_hot = np.array(hot, dtype=np.int32)
        for batch in batches:
            index, value = batch.column(3), batch.column(4)
            if index.null_count or value.null_count:
                raise ValueError("vector NULL")
            starts = np.append(0, np.cumsum(index.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
            flat, values = index.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False)
            step = max(1, min(int(ENTRIES * batch.num_rows // max(1, starts[-1])), (1 << 30) // max(1, len(is_hot))))
            for lo in range(0, batch.num_rows, step):
                hi = min(lo + step, batch.num_rows)
                part = slice(starts[lo], starts[hi])
                column, x = flat[part], values[part]
                row = np.repeat(np.arange(hi - lo), np.diff(starts[lo:hi + 1]))
                place = np.minimum(np.searchsorted(is_hot, column), max(len(is_hot) - 1, 0))
                dense = is_hot[place] == column if len(is_hot) else np.zeros(len(column), dtype=bool)
                full = np.flatnonzero(2 * np.bincount(place[dense], minlength=len(is_hot)) > hi - lo)
                matrix = np.zeros((hi - lo, len(is_hot)))
                matrix[row[dense], place[dense]] = x[dense]
                gaps = dense & ~np.isin(place, full)
                flat_at = row * len(is_hot) + place
                one, cold = gaps & (x == 1), ~dense
                fields = [*(batch.column(i).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for i in range(3)),
                          is_hot, full, matrix[:, full], flat_at[one], flat_at[gaps & ~one], x[gaps & ~one],
                          row[cold], column[cold], x[cold] if (x[cold] != 1).any() else np.empty(0)]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(f, dtype=t).tobytes()], pa.binary()) for f, t in zip(fields, _TYPES.values())],
                                                 names=list(_BINARY))

    blocks = rows.select("fold", "label", "weight", "index", "value").mapInArrow(run, ", ".join(f"`{c}` binary" for c in _BINARY))
    # a writer looks at the size of a row group after a hundred rows, which here are blocks, and dictionaries of blocks are of no use
    cut = cut_lineage(blocks, options={"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8,
                                       "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 8, "parquet.enable.dictionary": "false"})
    return Packed(cut, width, n)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            f = {c: np.frombuffer(batch.column(k)[i].as_buffer(), dtype=_TYPES[c]) for k, c in enumerate(_BINARY)}
            dense = np.zeros((len(f["label"]), len(f["hot"])))
            dense[:, f["full"]] = f["full_value"].reshape(len(dense), len(f["full"]))
            places = dense.reshape(-1)
            places[f["one"]] = 1
            places[f["at"]] = f["value"]
            value = f["cold_value"] if len(f["cold_value"]) else np.ones(len(f["cold_row"]))
            yield Block(f["fold"], f["label"], f["weight"], f["hot"], dense, f["cold_row"], f["cold_column"], value)


def summed(data: Packed, held: object, columns: int, extras: int,
           work: Callable[[object, Block], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One pass: (matrix of ``data.width`` rows and ``columns`` columns, vector of ``extras``) summed over all blocks.

    ``work(held, block)`` gives what each row adds to its columns and the
    block's extras; ``held`` is broadcast.  A task returns the columns that
    its rows have.
    """
    spark = data.blocks.sparkSession
    sent = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, other = Gradient(), np.zeros(extras)
        for block in blocks_of(batches):
            rest, extra = work(sent.value, block)
            other += extra
            total.add(*block.sums(rest))
        at, sums = total.merged()
        values = [at.astype(np.int32), sums, other]
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values], names=["at", "sums", "other"])

    matrix, vector = np.zeros((data.width, columns)), np.zeros(extras)
    result = data.blocks.mapInArrow(run, "at binary, sums binary, other binary").toArrow()  # a row per task
    for at, sums, other in zip(*(result.column(i) for i in range(3))):
        at = np.frombuffer(at.as_buffer(), dtype=np.int32)
        if len(at):
            matrix[at] += np.frombuffer(sums.as_buffer(), dtype=np.float64).reshape(len(at), columns)
        vector += np.frombuffer(other.as_buffer(), dtype=np.float64)
    sent.destroy()
    return matrix, vector
