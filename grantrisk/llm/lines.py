"""Line dedup with two Bloom filters.

A line's key is the line stripped of ASCII spaces and with A-Z lowered.  Pass
one reads all lines and fills two filters per task: keys seen once and keys
seen in a second document.  Filters of two tasks merge without losing a
repeat: once = a | b, twice = ta | tb | (a & b).  They are merged by segment
across the cluster, and only the twice-filter comes back, as a broadcast of a
fixed size.  Pass two tests every line against it; lines that hit are
suspected repeats.  Only their 16-byte digests and document ids are shuffled:
an aggregate per digest tells true repeats and their first document.  A false
hit costs a shuffled digest and never changes a result.

The filter has eight bits or more for each line up to ``MAX_BITS``; beyond
that more lines are suspected and shuffled, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, staged

#: 2 ** 28 bits: 32 MB on each executor and on the driver.
MAX_BITS = 1 << 28
MIN_BITS = 1 << 20
#: Bits of a segment; filters are merged and sent by segment.
SEGMENT_BITS = 1 << 19
HASHES = 3
MIN_CODE_POINTS = 10
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: bytes, min_code_points: int = MIN_CODE_POINTS) -> bytes | None:
    """The key of a line, or None when it has too few code points to count."""
    key = line.strip(SPACES).lower()  # bytes.lower() changes A-Z only
    if len(key) < min_code_points or len(key) < 4 * min_code_points and len(key.decode()) < min_code_points:
        return None
    return key


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit positions of each 64-bit hash, one row per hash."""
    step = (hashes * _GOLDEN) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) >> np.uint64(64 - bits.bit_length() + 1) for i in range(HASHES)], axis=1)


def _hashes(raw: bytes, min_code_points: int) -> np.ndarray:
    """Hashes of the different keys of a text."""
    keys = {k for line in raw.split(b"\n") if (k := line_key(line, min_code_points)) is not None}
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))


def _hit(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of positions whose bits are all set."""
    return ((packed[at >> np.uint64(3)] & (128 >> (at & np.uint64(7))).astype(np.uint8)) > 0).all(axis=1)


def _set(packed: np.ndarray, at: np.ndarray) -> None:
    at = np.unique(at)
    where, bit = at >> np.uint64(3), (128 >> (at & np.uint64(7))).astype(np.uint8)
    first = np.flatnonzero(np.diff(where, prepend=where[:1] + np.uint64(1))) if len(at) else []
    if len(first):
        packed[where[first]] |= np.bitwise_or.reduceat(bit, first)


class _Filters:
    """The pair of filters of one task, as packed bits."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.once, self.twice = (np.zeros(bits // 8, dtype=np.uint8) for _ in range(2))

    def add(self, hashes: np.ndarray) -> None:
        """Add keys, each of another document or another key of the same."""
        unique, times = np.unique(hashes, return_counts=True)
        at = _positions(unique, self.bits)
        _set(self.twice, at[_hit(self.once, at) | (times > 1)])
        _set(self.once, at)


def build_filter(docs: DataFrame, text_col: str, bits: int, min_code_points: int = MIN_CODE_POINTS) -> np.ndarray:
    """The twice-filter of all lines of ``docs`` as packed bits; rows that share an id may count as two documents."""
    rows = docs.select(F.col(text_col).cast("binary").alias("raw"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, waiting, held = _Filters(bits), [], 0
        for batch in batches:
            for raw in batch.column(0):
                found = _hashes(raw.as_py() or b"", min_code_points)
                waiting.append(found)
                held += len(found)
                if held >= 1 << 17:
                    filters.add(np.concatenate(waiting))
                    waiting, held = [], 0
        if held:
            filters.add(np.concatenate(waiting))
        press = zstandard.ZstdCompressor(level=1)
        for segment in range(max(1, bits // SEGMENT_BITS)):
            part = slice(segment * SEGMENT_BITS // 8, (segment + 1) * SEGMENT_BITS // 8)
            if filters.once[part].any():
                packed = [press.compress(f[part].tobytes()) for f in (filters.once, filters.twice)]
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), *[pa.array([p], pa.binary()) for p in packed]],
                                                 names=["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for segment, once, twice in zip(*[c.to_pylist() for c in batch.columns]):
                once, twice = (np.frombuffer(unpress.decompress(x), dtype=np.uint8) for x in (once, twice))
                if segment in sums:
                    a, b = sums[segment]
                    b |= twice
                    b |= a & once
                    a |= once
                else:
                    sums[segment] = [once.copy(), twice.copy()]
        for segment, (_, twice) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([twice.tobytes()], pa.binary())],
                                             names=["segment", "twice"])

    segments = max(1, bits // SEGMENT_BITS)
    merged = rows.mapInArrow(fill, "segment int, once binary, twice binary") \
        .repartition(segments, "segment").mapInArrow(merge, "segment int, twice binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in merged.collect():  # bits / 8 bytes at most
        at = row.segment * SEGMENT_BITS // 8
        out[at:at + len(row.twice)] = np.frombuffer(row.twice, dtype=np.uint8)
    return out


def filter_bits(lines: int) -> int:
    """A power of two, eight bits a line or more, within MIN_BITS and MAX_BITS."""
    return min(max(1 << (8 * max(lines, 1) - 1).bit_length(), MIN_BITS), MAX_BITS)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def suspects(docs: DataFrame, text_col: str, id_col: str, twice: np.ndarray, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """(id, digest) of the lines that hit the twice-filter, once per row and key."""
    spark: SparkSession = docs.sparkSession
    held, bits = spark.sparkContext.broadcast(twice.tobytes()), len(twice) * 8
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(held.value, dtype=np.uint8)
        for batch in batches:
            ids, digests = [], []
            for i, raw in enumerate(batch.column(1)):
                keys = list({k for line in (raw.as_py() or b"").split(b"\n") if (k := line_key(line, min_code_points)) is not None})
                if not keys:
                    continue
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))
                for k in np.flatnonzero(_hit(filled, _positions(hashes, bits))):
                    ids.append(i)
                    digests.append(_digest(keys[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(digests, pa.binary())],
                                             names=["id", "digest"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("digest", T.BinaryType())]))


def lines_to_drop(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """(id, digests): for each document the digests of the lines that an earlier document holds."""
    text = F.col(text_col).cast("binary")
    lines = docs.agg(F.sum(F.octet_length(text) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)).first()[0]
    twice = build_filter(docs, text_col, filter_bits(int(lines or 0)), min_code_points)
    found = staged(suspects(docs, text_col, id_col, twice, min_code_points), "suspects")
    # NULL ids count as one document, after all others.
    first = F.min("id")
    repeats = found.groupBy("digest").agg(first.alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("odd")) \
        .where("first <> last or (odd and first is not null)")
    # Written first: a join of two plain tables can split the suspects of a frequent line.
    repeats = staged(repeats.select("digest", "first"), "repeats")
    gone = found.join(repeats, "digest").where("id is null or id <> first")
    return gone.groupBy("id").agg(F.collect_set("digest").alias("digests"))


def drop_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", out_col: str | None = None,
               min_code_points: int = MIN_CODE_POINTS, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the repeated lines cut from ``text_col`` (or the result in ``out_col``).

    Texts are split at line feeds.  Keys of ``min_code_points`` or more that
    at least two documents hold lose all their lines except in the document
    with the smallest id, where all of them stay; the other lines stay too,
    joined by line feeds.  A document is an id: rows sharing one are never
    repeats of each other, and rows without an id count as one document that
    comes last.  NULL and empty texts are one empty line; a NULL text that
    loses nothing stays NULL.  ``counts`` names columns for the number of
    lines before and of the lines dropped.
    """
    drops = lines_to_drop(docs, text_col, id_col, min_code_points)
    into, t, d = out_col or text_col, free_name(docs.columns, "__t"), free_name(docs.columns, "__d")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("__id"),
                       F.col(text_col).cast("string").alias("__text"))
    joined = held.join(drops, held["__id"].eqNullSafe(drops["id"]), "left").drop("id")
    n, gone = counts or (into, into)
    kept = [f for f in docs.schema.fields if f.name.lower() not in {into.lower(), n.lower(), gone.lower()}]
    flat = joined.select(*[F.col("row").getField(f.name).alias(f.name) for f in kept], F.col("__text").alias(t), F.col("digests").alias(d))
    schema = T.StructType([*kept, T.StructField(into, T.StringType()), *([T.StructField(x, T.LongType()) for x in counts or ()])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, befores, dropped = [], [], []
            for text, digests in zip(batch.column(len(kept)), batch.column(len(kept) + 1)):
                text, digests = text.as_py(), digests.as_py()
                if digests is None or text is None:
                    texts.append(text)
                    befores.append((text or "").count("\n") + 1)
                    dropped.append(0)
                    continue
                digests, lines = set(digests), text.encode().split(b"\n")
                rest = [x for x in lines if (k := line_key(x, min_code_points)) is None or _digest(k) not in digests]
                texts.append(b"\n".join(rest).decode())
                befores.append(len(lines))
                dropped.append(len(lines) - len(rest))
            new = [pa.array(texts, pa.string()), *([pa.array(befores, pa.int64()), pa.array(dropped, pa.int64())] if counts else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *new], names=schema.names)

    return flat.mapInArrow(cut, schema)
