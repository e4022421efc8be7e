"""SimHash near-dedup with multi-index hashing.

A text's fingerprint has a bit set where over half of its shingles' hashes
have it.  Two fingerprints within ``max_bits`` differ little in at least one
of ``segments`` segments: with segment radii whose sum plus the number of
segments is max_bits + 1, some segment lies within its radius.  So each
fingerprint is entered into a table under the exact value of every segment,
and looks up the Hamming ball around its value.  Fetched pairs are verified
over all 64 bits.

Equal fingerprints are one entry, so copies cost nothing; a table row that
very many fingerprints share is split into blocks.  A task hands on the links
it has verified as a forest of its fingerprints, never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, forest, in_blocks, sorted_groups, staged

SEED = 42
#: A table row with more entries than this is split into blocks.
BLOCK = 1024
#: Compare about so many pairs at a time.
PAIRS = 1 << 21


def fingerprint_of(text: str | None, shingle: int, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of the whole text; 0 without words."""
    raw = (text or "").encode().lower()  # bytes.lower() changes A-Z only
    words = raw.split()  # cuts at the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - shingle + 1, 1)
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        first = starts[at:min(at + (1 << 16), n)].tolist()
        last = ends[min(at + shingle, len(words)) - 1:].tolist()
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(first, last)], dtype=">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n).view(">i8")[0])


def fingerprint(text: Column, shingle: int = 4, seed: int = SEED) -> Column:
    """Column of fingerprints (long).

    Texts are A-Z lower-cased and split at ASCII spaces; shingles of
    ``shingle`` words, repeats included, are joined by a space and hashed
    with XXH64.  Fewer words make one shingle; NULL, empty and blank texts
    have fingerprint 0.
    """
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle, seed) for t in texts], dtype="int64")

    return of(text)


def radii(segments: int, max_bits: int) -> list[int]:
    """Radius of each segment: as even as can be, with sum(radius + 1) = max_bits + 1."""
    return [(max_bits + 1 + i) // segments - 1 for i in reversed(range(segments))]


def default_segments(entries: int) -> int:
    """Three segments for tables of over four million entries, else four; the result is the same."""
    return 3 if entries > 1 << 22 else 4


def _lookups(value: Column, masks: list[int], base: int) -> Column:
    """Array of (key, probe) for the values that differ from ``value`` in a mask whose lowest bit it has set."""
    asks = F.filter(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseAND(m.bitwiseAND(-m)) != 0)
    return F.transform(asks, lambda m: F.struct((value.bitwiseXOR(m) + F.lit(base)).alias("key"), F.lit(True).alias("probe")))


def _entries(fps: DataFrame, segments: int, max_bits: int) -> DataFrame:
    """(key, fp, probe): each fingerprint under its segments' values, and its look-ups around them.

    Of two values that differ in a mask of bits, the one that has the lowest
    of them set does the looking up, so each neighbour is met once.
    """
    cuts = [64 * i // segments for i in range(segments + 1)]
    rows = []
    for i, radius in enumerate(radii(segments, max_bits)):
        if radius < 0:
            continue
        width = cuts[i + 1] - cuts[i]
        value = F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << width) - 1))
        key = value + F.lit(i << 58)
        rows.append(F.array(F.struct(key.alias("key"), F.lit(False).alias("probe"))))
        masks = [sum(1 << b for b in bits) for k in range(1, radius + 1) for bits in combinations(range(width), k)]
        if masks:
            rows.append(_lookups(value, masks, i << 58))
    return fps.select("fp", F.inline(F.concat(*rows)))


def links(fps: DataFrame, max_bits: int = 4, segments: int | None = None) -> DataFrame:
    """(a, b): forest of the different fingerprints ``fp`` that lie within ``max_bits`` of each other.

    Its trees are those that all links would make.
    """
    entries = _entries(fps, segments or default_segments(fps.count()), max_bits)
    rows = in_blocks(entries, ["key"], "fp", BLOCK).select("key", "pair", "probe", "fp")
    rows = rows.repartition("key", "pair").sortWithinPartitions("key", "pair", "probe")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in sorted_groups(batches, ["key", "pair"]):
            fp = batch.column(3).to_numpy()
            bits, n = fp.view(np.uint64), batch.num_rows
            if len(starts) == 1 or starts[-1] != n:
                starts = np.append(starts, n)
            later = np.repeat(starts[1:], np.diff(starts)) - np.arange(n) - 1
            # Entries come before look-ups, and each entry is compared with all that follow in its group.
            later[batch.column(2).to_numpy(zero_copy_only=False)] = 0
            found, upto, at = [], np.cumsum(later), 0
            while at < n:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
                times = later[at:end]
                first = np.repeat(np.arange(at, end), times)
                second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times)
                near = np.flatnonzero(np.bitwise_count(bits[first] ^ bits[second]) <= max_bits)
                if len(near):
                    found.append(forest(fp[first[near]], fp[second[near]]))
                at = end
            if found:
                a, b = forest(*map(np.concatenate, zip(*found)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.mapInArrow(verify, "a long, b long")


def groups(marked: DataFrame, max_bits: int = 4, segments: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """(fp, tree, component_id): for each different ``fp`` of ``marked`` its group and the smallest id that this holds.

    ``marked`` has columns ``fp`` and ``id_col`` and is read twice; pass a
    staged table.  NULL ids count only where a group has no other.
    """
    fps = staged(marked.groupBy("fp").agg(F.min(id_col).alias("first")), "fingerprints")
    found = components(links(fps.select("fp"), max_bits, segments))
    tree = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("tree"))
    least = tree.groupBy("tree").agg(F.min("first").alias("component_id"))
    return staged(tree.join(least, "tree").select("fp", "tree", "component_id"), "simhash-groups")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4, max_bits: int = 4,
                    segments: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    Groups are the connected components under "at most ``max_bits`` of the
    fingerprint differ"; ``component_id`` is a group's smallest id.  All
    texts without words have fingerprint 0 and are one group.  Repeated rows
    stay; an empty table gives none.
    """
    marked = staged(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col).cast("string"), shingle).alias("fp")), "simhash")
    return marked.join(groups(marked, max_bits, segments), "fp").drop("tree")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4, max_bits: int = 4,
             segments: int | None = None) -> DataFrame:
    """The columns of ``docs``, one row of each group: that with the smallest id.

    Of rows that repeat this id, the one with the smallest md5 of its text
    stays, of rows that repeat the text too, that with the smallest hash of
    all its columns.
    """
    text = F.col(text_col).cast("string")
    key = F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("text_key")
    slim = staged(docs.select(F.col(id_col).alias("doc_id"), key, fingerprint(text, shingle).alias("fp")), "simhash")
    first = slim.join(groups(slim.select("fp", "doc_id"), max_bits, segments), "fp") \
        .where(F.col("doc_id").eqNullSafe(F.col("component_id"))) \
        .groupBy("tree").agg(F.min("text_key").alias("text_key"), F.first("component_id").alias("doc_id"))

    def keys(doc_id: Column) -> list[Column]:  # never NULL, so that both sides meet by plain equality
        return [doc_id.isNull().alias("k0"), F.coalesce(doc_id.cast("string"), F.lit("")).alias("k1")]

    kept = first.select(*keys(F.col("doc_id")), F.col("text_key").alias("k2"))
    # Texts are shuffled once: repeated rows are merged before, and the join finds them dealt by its keys.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys(F.col(id_col)), key.alias("k2"))
    rows = rows.groupBy("k0", "k1", "k2").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.join(kept, ["k0", "k1", "k2"], "left_semi").select("row.*")
