"""Helpers shared by the operators: staging, word patterns, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Words are runs of anything but these six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage so that later passes neither repeat the work nor depend
    on an executor's disk, and keeps columns prunable.  ``options``: of the
    Parquet writer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: Iterable[str], base: str) -> str:
    """``base``, lengthened until it clashes with none of ``columns``."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def word_count(text: Column) -> Column:
    """Number of words as long; NULL counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_fold(col: str, parts: int, part: int) -> Column:
    """True for ids whose crc32 as text (NULL: as the empty text) leaves ``part`` modulo ``parts``."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % parts == part


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list -> (node, component).

    ``component`` is the smallest node that can be reached.  Only nodes with
    an edge appear.  Alternating large-star and small-star rounds: each round
    takes every node's smallest neighbour with a map-side combined minimum
    and hangs the neighbours below it, so no neighbour list is ever gathered
    in one task; a hub's edges are one side of an equi-join that adaptive
    execution may split.  Each round is staged in the shared folder.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v") \
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = staged(e, "edges")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u hangs below u's minimum
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        # small star: u and its smaller neighbours hang below the smallest of them
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        e = big.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") \
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = staged(e, "edges")
        # a fixed point is a forest of stars: the sum over all edges no longer moves
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def in_blocks(rows: DataFrame, key: list[str], member: str, limit: int) -> DataFrame:
    """Split the groups of ``key`` so that every pair of members meets in a task-sized group.

    Groups of up to ``limit`` rows stay whole.  Larger ones are cut by a hash
    of ``member`` into blocks of about ``limit`` rows, and each row goes to
    every pair of blocks that its own belongs to.  Adds ``block`` and
    ``pair`` (i * 2**31 + j, i <= j); (key, pair) is the new group, of about
    2 * limit rows at most.  Rows i != j of one pair of blocks need comparing
    across the blocks only.
    """
    blocks = F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("blocks")
    hot = rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(*key, blocks)
    out = rows.join(hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    out = out.withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    out = out.withColumn("other", other)
    pair = F.least("block", "other").cast("long") * F.lit(1 << 31) + F.greatest("block", "other")
    return out.withColumn("pair", pair).drop("other", "blocks")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a[i] - b[i] as a forest of stars: the nodes that aren't the smallest of their tree, and their roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, label = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[left], label[right]), label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    below = label != np.arange(len(nodes))
    return nodes[below], nodes[label[below]]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of rows that arrive sorted by the long columns ``keys``: (rows, start of each group and the end)."""
    rest = None
    for batch in batches:
        if rest is not None and rest.num_rows:
            batch = pa.concat_batches([rest, batch])
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            values = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change)])
        if starts[-1]:
            yield batch.slice(0, starts[-1]), starts
        rest = batch.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def text_slices(batch: pa.RecordBatch, columns: Sequence[int], size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``size`` bytes in the given text columns each."""
    if not batch.num_rows:
        return
    lengths = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64 for c in columns)
    upto, start = np.cumsum(lengths), 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + size)))
        yield batch.slice(start, end - start)
        start = end


#: Ids of some words one after the other, and where each word's begin and the last one's end.
Coded = tuple[np.ndarray, np.ndarray]


def remembered(encoders: Sequence[Callable[[list[str]], Coded]], most: int = 1 << 18, longest: int = 48) -> Callable[[pa.Array], list[pa.ListArray]]:
    """Lists of ids of different words by each encoder; a word that was seen not long ago isn't encoded again.

    About ``most`` words of up to ``longest`` bytes are remembered at a time.
    """
    known, lists = pa.array([], pa.string()), [pa.array([], pa.list_(pa.int32()))] * len(encoders)

    def ids_of(words: pa.Array) -> list[pa.ListArray]:
        nonlocal known, lists
        place = pc.index_in(words, value_set=known)
        missing = place.is_null().to_numpy(zero_copy_only=False)
        new = words.filter(pa.array(missing))
        fresh, texts = [], new.to_pylist()
        for encode in encoders:
            ids, starts = encode(texts) if texts else (np.zeros(0, np.int32), np.zeros(1, np.int64))
            fresh.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())))
        at = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at[missing] = len(known) + np.arange(len(new))
        every = [pa.concat_arrays(pair) for pair in zip(lists, fresh)]
        out = [x.take(pa.array(at)) for x in every]
        short = np.flatnonzero(pc.binary_length(new).to_numpy(zero_copy_only=False) <= longest)
        if len(known) + len(short) <= most:
            keep = np.append(np.arange(len(known)), len(known) + short)
            known = pa.concat_arrays([known, new.take(pa.array(short))])
            lists = every if len(short) == len(new) else [x.take(pa.array(keep)) for x in every]
        else:
            known, lists = new.take(pa.array(short)), [x.take(pa.array(short)) for x in fresh]
        return out

    return ids_of
