"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Documents with equal texts are one group.  A group is a vector (bytes,
tokens, rows) in units of a shard's fair share.  Vectors are placed largest
first, each on the shard where its dot product with the shard's residual
capacity is highest.

What is placed one by one is bounded by parameters, never by the corpus:
* groups with over 1/GRAIN of a fair share in some dimension (at most
  3 * n_shards * GRAIN of them),
* the pieces of groups beyond a fair share, which no shard could hold,
  each of 1/PIECES of a share,
* all other groups, dealt by hash into n_shards * GRAIN bundles.
The placement is a table of that bounded size, broadcast to the documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import row_number_global
from .common import free_name, staged, word_count

GRAIN = 128
PIECES = 8
SLOT_BUCKETS = 1024


def place(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each vector, in units of a shard's capacity: dot-product placement, largest first.

    Among the shards that can take the vector, the one whose residual has the
    highest dot product with it; among all of them when none can.
    """
    residual = np.ones((n_shards, vectors.shape[1]))
    shard = np.zeros(len(vectors), dtype=np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -vectors.sum(axis=1), -vectors.max(axis=1))):
        score = residual @ vectors[i]
        fits = (residual >= vectors[i]).all(axis=1)
        shard[i] = k = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        residual[k] -= vectors[i]
    return shard


def documents_to_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(row, doc_id, size, text_crc32, tokens, text_key): what packing needs of each document, staged.

    ``size`` is the text's UTF-8 bytes plus ``overhead`` (NULL: no bytes).
    ``text_key`` is the md5 of the text; NULL texts form a group of their own.
    ``row`` tells repeated rows apart and is fixed by the staging.
    """
    return _to_pack(docs, F.monotonically_increasing_id(), F.col(id_col), F.col(text_col), overhead)


def _to_pack(docs: DataFrame, row: Column, doc_id: Column, text: Column, overhead: int = 16) -> DataFrame:
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    return staged(docs.select(
        row.alias("row"), doc_id.alias("doc_id"),
        (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        word_count(text).alias("tokens"), F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("text_key"),
    ), "to-pack")


def pack(items: DataFrame, n_shards: int = 40) -> DataFrame:
    """``items`` (see ``documents_to_pack``) with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in a shard)."""
    spark = items.sparkSession
    groups = staged(items.groupBy("text_key").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"),
                                                  F.count("*").alias("r")), "groups")
    total = groups.agg(F.sum("b"), F.sum("t"), F.sum("r")).first()
    share = [float(x or 0) / n_shards or 1.0 for x in total]
    load = F.greatest(*[F.col(c) / F.lit(s) for c, s in zip("btr", share)])
    bundles = n_shards * GRAIN
    heavy = groups.withColumn("load", load).where(F.col("load") > 1 / GRAIN) \
        .withColumn("pieces", F.when(F.col("load") > 1, F.ceil(F.col("load") * PIECES)).otherwise(1).cast("int"))
    heavy = staged(heavy.select("text_key", "pieces"), "heavy")  # at most 3 * n_shards * GRAIN rows
    marked = items.join(F.broadcast(heavy), "text_key", "left") \
        .withColumn("unit", F.when(F.col("pieces").isNull(), "").otherwise(F.col("text_key"))) \
        .withColumn("part", F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("text_key"), F.lit(bundles)))
                    .otherwise(F.pmod(F.xxhash64("row"), F.col("pieces"))).cast("int")).drop("pieces")
    marked = staged(marked, "units")
    units = marked.groupBy("unit", "part").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"),
                                               F.count("*").alias("r")).orderBy("unit", "part").toPandas()
    vectors = units[["b", "t", "r"]].to_numpy(dtype=float) / np.array(share)
    rows = zip(units["unit"], units["part"].astype(int).tolist(), place(vectors, n_shards).tolist())
    placed = spark.createDataFrame([(str(u), p, s) for u, p, s in rows], "unit string, part int, shard int")
    out = marked.join(F.broadcast(placed), ["unit", "part"]).drop("unit", "part")
    slotted = row_number_global(out, [F.col("row")], F.pmod(F.xxhash64("row"), F.lit(SLOT_BUCKETS)), ["shard"], "slot")
    return slotted.withColumn("slot", F.col("slot") - 1)


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, tokens, text_key, shard, slot.

    Equal texts share a shard unless together they exceed a shard's fair
    share of bytes, tokens or rows; such a group is dealt out in pieces.
    Empty tables give no rows; NULL ids and repeated rows are kept as they are.
    """
    return pack(documents_to_pack(docs, id_col, text_col), n_shards).drop("row")


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every row of ``docs`` once, with its columns, in folders ``shard=K`` (``shard_=K`` if there is a column shard).

    Rows are told apart by a staged number, so ids may be NULL or repeated.
    """
    held = staged(docs.select(F.monotonically_increasing_id().alias("row"),
                              F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "to-write")
    doc = F.col("doc")
    packed = pack(_to_pack(held, F.col("row"), doc.getField(id_col), doc.getField(text_col)), n_shards)
    folder = free_name(docs.columns, "shard")
    held.join(packed.select("row", F.col("shard").alias("__shard")), "row").select("doc.*", F.col("__shard").alias(folder)) \
        .write.partitionBy(folder).parquet(path)
