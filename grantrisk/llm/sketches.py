"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text is a set of paragraph digests; repeats of a paragraph are numbered, so
the second one is a digest of its own.  A paragraph is a line; lines are cut
further where the bytes before a place say so, about every four words, so an
edit within a line touches the paragraphs around it only and the others keep
their digests.

A sketch has three rows of cells.  Each digest goes into one cell of each row:
the cell counts it, adds it to a sum, and adds a hash of it to a check sum.
The sketch of one version less that of another holds just what differs.  A
cell with a count of 1 or -1 whose check sum fits its sum holds a single
digest; it is read off and taken out of its other cells, which may lay bare
the next (peeling).  If cells are left in the end the sketch was too small for
the difference, and both are made again with four times the cells.

The fingerprint of a text is its smallest sketch, 24 cells whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, text_slices

ROWS = 3
#: Cells of a row in a fingerprint; sizes are powers of two, four times as large at each retry.
CELLS = 8
#: One in so many spaces ends a paragraph, and one in so many characters whatever it is.
AT_SPACE, ANYWHERE = 4, 256
#: Texts are worked on in batches of about so many bytes, sketches in blocks of about so many cells.
BATCH_BYTES, BLOCK_CELLS = 2 << 20, 1 << 21
_GOLD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Keys(NamedTuple):
    """Digests of the paragraphs of some texts one after the other, and where each text's begin and the last one's end."""
    key: np.ndarray
    starts: np.ndarray

    def of(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the given texts and, for each, the place of its text in ``texts``."""
        sizes = self.starts[texts + 1] - self.starts[texts]
        begin = np.repeat(self.starts[texts] - np.cumsum(sizes) + sizes, sizes)
        return self.key[begin + np.arange(len(begin))], np.repeat(np.arange(len(texts)), sizes)


def paragraph_starts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where paragraphs begin in texts that stand one after the other; no cut looks beyond the beginning of its text."""
    n = len(raw)
    start = np.zeros(n + 1, dtype=bool)
    start[1:][raw == 10] = True
    if n > 5:
        # a hash of the four bytes before the last one, for each place from the fifth byte on
        h = np.zeros(n - 4, dtype=np.uint32)
        for k in range(4):
            h = (h + raw[k:n - 4 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        letter = np.append((raw[5:] & 0xC0) != 0x80, False)
        cut = ((raw[4:] == 32) & (h % AT_SPACE == 0)) | (letter & (h % ANYWHERE == 1))
        since = np.arange(5, n + 1) - bounds[np.searchsorted(bounds, np.arange(5, n + 1) - 1, side="right") - 1]
        start[5:] |= cut & (since >= 5)
    start[bounds] = True
    return np.flatnonzero(start[:n])


def keys_of(texts: Sequence[bytes]) -> Keys:
    """Digests of the paragraphs of texts in UTF-8."""
    import xxhash

    bounds = np.cumsum([0, *map(len, texts)])
    whole = b"".join(texts)
    begin = paragraph_starts(np.frombuffer(whole, dtype=np.uint8), bounds)
    digest = xxhash.xxh64_intdigest
    edges = [*begin.tolist(), len(whole)]
    key = np.fromiter([digest(whole[s:e]) for s, e in zip(edges[:-1], edges[1:])], dtype=np.uint64, count=len(begin))
    starts = np.searchsorted(begin, bounds)
    of = np.repeat(np.arange(len(texts)), np.diff(starts))
    order = np.lexsort((key, of))
    new = np.append(True, (key[order][1:] != key[order][:-1]) | (of[order][1:] != of[order][:-1]))[:len(order)]
    run = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    again = order[run > 0]
    key[again] = _mix(key[again] + run[run > 0].astype(np.uint64) * np.uint64(_GOLD))
    return Keys(key, starts)


class Cells(NamedTuple):
    """Sketches of some texts: counts, sums and check sums, each as (text, row, cell)."""
    count: np.ndarray
    total: np.ndarray
    check: np.ndarray

    def less(self, other: Cells) -> Cells:
        return Cells(*[a - b for a, b in zip(self, other)])


def _check(key: np.ndarray) -> np.ndarray:
    return (_mix(key ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def _places(key: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """For each row the flat number of the cell that the digests of the texts ``at`` go into."""
    return np.stack([(at * ROWS + row) * size + (_mix(key + np.uint64((ROWS * size + row) * _GOLD % (1 << 64)))
                                                & np.uint64(size - 1)).astype(np.int64) for row in range(ROWS)])


def sketch(key: np.ndarray, at: np.ndarray, texts: int, size: int) -> Cells:
    """Sketches with ``size`` cells a row of ``texts`` texts, of digests that belong to the texts ``at``."""
    cells = Cells(np.zeros(texts * ROWS * size, np.int32), np.zeros(texts * ROWS * size, np.uint64), np.zeros(texts * ROWS * size, np.uint32))
    check = _check(key)
    for place in _places(key, at, size):
        np.add.at(cells.count, place, np.int32(1))
        np.add.at(cells.total, place, key)
        np.add.at(cells.check, place, check)
    return Cells(*[c.reshape(texts, ROWS, size) for c in cells])


def peel(cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether each sketch could be read off whole, and all that was: digests, signs and the sketch of each."""
    texts, _, size = cells.count.shape
    count, total, check = (c.ravel().copy() for c in cells)
    look, found = np.flatnonzero(count), []
    while len(look):
        sign = count[look]
        look, sign = look[np.abs(sign) == 1], sign[np.abs(sign) == 1]
        key = np.where(sign > 0, total[look], -total[look])
        fits = check[look] == np.where(sign > 0, _check(key), -_check(key))
        look, sign, key = look[fits], sign[fits], key[fits]
        at, row = look // (ROWS * size), look // size % ROWS
        place = _places(key, at, size)
        ours = place[row, np.arange(len(look))] == look  # else a chance fit
        for other in range(ROWS - 1):  # bare in an earlier row too: read off there
            ours &= (row <= other) | (count[place[other]] != sign) | (total[place[other]] != total[look]) | (check[place[other]] != check[look])
        sign, key, at, place = sign[ours], key[ours], at[ours], place[:, ours]
        if not len(key):
            break
        sums = np.where(sign > 0, key, -key), np.where(sign > 0, _check(key), -_check(key))
        for one in place:
            np.subtract.at(count, one, sign)
            np.subtract.at(total, one, sums[0])
            np.subtract.at(check, one, sums[1])
        found.append((key, sign, at))
        look = np.unique(place)
    left = ((count != 0) | (total != 0) | (check != 0)).reshape(texts, -1).any(axis=1)
    key, sign, at = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, d) for d in (np.uint64, np.int32, np.int64))
    return ~left, key, sign, at


def differences(keys: Keys, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests that only one of the texts a[i] and b[i] holds, their signs (1: only a) and i, for all i.

    Sketches start at CELLS cells a row, or where they could hold the
    difference of the numbers of paragraphs, and grow until all is read off.
    """
    sizes = np.diff(keys.starts)
    left, size, out = np.arange(len(a)), CELLS, []
    apart = np.abs(sizes[a] - sizes[b])
    while len(left):
        if size > 1 << 40:
            raise RuntimeError("a difference could not be read off")
        later, now = left[apart[left] > ROWS * size], left[apart[left] <= ROWS * size]
        failed = [later]
        step = max(1, BLOCK_CELLS // (ROWS * size))
        for s in range(0, len(now), step):
            part = now[s:s + step]
            one, two = (sketch(*keys.of(x[part]), len(part), size) for x in (a, b))
            whole, key, sign, at = peel(one.less(two))
            good = whole[at]
            out.append((key[good], sign[good], part[at[good]]))
            failed.append(part[~whole])
        left, size = np.concatenate(failed), 4 * size
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64))


def likeness(keys: Keys, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the paragraphs of a[i] and b[i] that both hold (1 for two texts without any)."""
    sizes = np.diff(keys.starts)
    both = sizes[a] + sizes[b]
    apart = np.bincount(differences(keys, a, b)[2], minlength=len(a))
    return np.where(both > 0, 1 - apart / np.maximum(both, 1), 1.0)


def _packed(keys: Keys, texts: np.ndarray, size: int = CELLS) -> list[bytes]:
    """Sketches as bytes: counts (32 bits), sums (64 bits) and check sums (32 bits), little-endian."""
    cells = sketch(*keys.of(texts), len(texts), size)
    raw = np.concatenate([c.reshape(len(texts), -1).astype(c.dtype.newbyteorder("<")).view(np.uint8).reshape(len(texts), -1)
                          for c in cells], axis=1)
    return [r.tobytes() for r in raw]


def _read(fingerprints: list[str]) -> Cells:
    """Fingerprints of one size as sketches."""
    raw = np.stack([np.frombuffer(base64.b64decode(f), dtype=np.uint8) for f in fingerprints])
    n = raw.shape[1] // 16
    parts = raw[:, :4 * n], raw[:, 4 * n:12 * n], raw[:, 12 * n:]
    return Cells(*[np.ascontiguousarray(p).view(t).astype(t[1:]).reshape(len(raw), ROWS, -1) for p, t in zip(parts, ("<i4", "<u8", "<u4"))])


def _utf8(texts: Sequence[str | None]) -> list[bytes]:
    return [(t or "").encode() for t in texts]


def _with(df: DataFrame, fields: list[T.StructField], columns: Sequence[str], values) -> DataFrame:
    """``df`` with ``fields``, made by ``values`` from the lists of values of ``columns``."""
    gone = {f.name.lower() for f in fields}
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in gone]
    at = [df.columns.index(c) for c in columns]
    names = [df.columns[i] for i in keep] + [f.name for f in fields]
    types = {"string": pa.string(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, at, BATCH_BYTES):
                new = values(*[batch.column(i).to_pylist() for i in at])
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [
                    pa.array(v, types[f.dataType.simpleString()]) for v, f in zip(new, fields)], names=names)

    return df.mapInArrow(run, T.StructType([df.schema.fields[i] for i in keep] + fields))


def fingerprints(docs: DataFrame, text_col: str = "text", into: str = "fingerprint", cells: int = CELLS) -> DataFrame:
    """``docs`` with the fingerprint of each whole text (NULL: of an empty one), in base64, ``cells`` (a power of two) a row.

    Every row stays; a column named ``into`` is replaced.
    """
    def values(texts: list) -> tuple:
        return [base64.b64encode(f).decode() for f in _packed(keys_of(_utf8(texts)), np.arange(len(texts)), cells)],

    return _with(docs, [T.StructField(into, T.StringType())], [text_col], values)


_LONGS = T.ArrayType(T.LongType())
_DIFFERENCE = [T.StructField("removed", _LONGS), T.StructField("added", _LONGS)]


def _sorted_lists(key: np.ndarray, sign: np.ndarray, at: np.ndarray, rows: int) -> list[list[np.ndarray]]:
    """Per sign (1, then -1) a list of ascending digests, as signed numbers, for each row."""
    out = []
    for wanted in (1, -1):
        mine = sign == wanted
        digest = key[mine].view(np.int64)
        order = np.lexsort((digest, at[mine]))
        out.append(np.split(digest[order], np.searchsorted(at[mine][order], np.arange(1, rows))))
    return out


def compare_fingerprints(pairs: DataFrame, old_col: str, new_col: str) -> DataFrame:
    """``pairs`` with ``removed`` and ``added``: the paragraph digests that only the old or new fingerprint holds.

    Both are NULL where a fingerprint is NULL, the sizes differ, or the
    difference is too large for them: compare larger ones, or the texts.
    """
    def values(old: list, new: list) -> list[list]:
        out = [[None] * len(old), [None] * len(old)]
        sizes: dict[int, list[int]] = {}
        for i, (a, b) in enumerate(zip(old, new)):
            if a is not None and b is not None and len(a) == len(b):
                sizes.setdefault(len(a), []).append(i)
        for rows in sizes.values():
            whole, key, sign, at = peel(_read([old[i] for i in rows]).less(_read([new[i] for i in rows])))
            for column, lists in zip(out, _sorted_lists(key, sign, at, len(rows))):
                for i, ok, digests in zip(rows, whole, lists):
                    column[i] = digests if ok else None
        return out

    return _with(pairs, _DIFFERENCE, [old_col, new_col], values)


def compare_texts(pairs: DataFrame, old_col: str, new_col: str) -> DataFrame:
    """``pairs`` with ``removed``, ``added`` (as in ``compare_fingerprints``) and ``likeness``, by sketches large enough for each pair."""
    def values(old: list, new: list) -> list:
        n, keys = len(old), keys_of(_utf8([*old, *new]))
        a, b = np.arange(n), np.arange(n, 2 * n)
        return [*_sorted_lists(*differences(keys, a, b), n), likeness(keys, a, b)]

    return _with(pairs, [*_DIFFERENCE, T.StructField("likeness", T.DoubleType())], [old_col, new_col], values)


_OUT = T.StructType([T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.BinaryType()),
                     T.StructField("fingerprint", T.BinaryType()), T.StructField("edited_fingerprint", T.BinaryType()),
                     T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
_ARROW = {"bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def _figures(texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns _OUT for texts and the ones that follow them."""
    n = len(texts)
    edited = []
    for text, after in zip(texts, following):
        k = len(text) // 4
        edited.append((text[:len(text) - k] + after[:k]).encode())
    keys = keys_of(_utf8(texts) + edited + _utf8(following))
    a, b, c = (np.arange(n) + k * n for k in range(3))
    values = ([len(t) for t in texts], [hashlib.sha256(e).digest() for e in edited], _packed(keys, a), _packed(keys, b),
              likeness(keys, a, b), likeness(keys, a, c))
    return [pa.array(v, _ARROW[f.dataType.simpleString()]) for v, f in zip(values, _OUT.fields)]


def edit_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited versions, and how alike they are to these and to the next text.

    The edited version ends in the beginning of the next document's text in
    place of the last quarter; the order is by id, NULL first, and by text
    hash for rows of one id; the first document follows the last one.  Every
    row stays; NULL texts are empty ones; a table of one row follows itself.

    Rows are sorted by ranges, so a task sees a run of neighbours; the last
    row of a run meets the first of the next one in a join of one row per task.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keys = ["id", "tie", "row"]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tie"),
                       F.monotonically_increasing_id().alias("row"), text.alias("text"))
    runs = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")
    id_field = T.StructField("id", rows.schema["id"].dataType)
    shape = T.StructType([id_field, *_OUT.fields, T.StructField("run", T.LongType()), T.StructField("first", T.BooleanType()),
                          T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last = TaskContext.get().partitionId(), None

        def edge(ids: pa.Array, value: str, first: bool) -> pa.RecordBatch:
            none = [pa.nulls(1, _ARROW[f.dataType.simpleString()]) for f in _OUT.fields]
            return pa.RecordBatch.from_arrays([ids, *none, pa.array([number]), pa.array([first]), pa.array([value])], names=shape.names)

        for whole in batches:
            for batch in text_slices(whole, [1], BATCH_BYTES):
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                if last is None:
                    yield edge(ids.slice(0, 1), texts[0], True)
                else:
                    ids, texts = pa.concat_arrays([last[0], ids]), [last[1], *texts]
                n = len(texts) - 1
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(0, n), *_figures(texts[:-1], texts[1:]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()),
                         pa.nulls(n, pa.string())], names=shape.names)
                last = ids.slice(n, 1), texts[n]
        if last is not None:
            yield edge(*last, False)

    found = staged(runs.mapInArrow(run, shape), "sketches", compression="zstd")
    firsts = found.where("first").select(F.col("run").alias("next_run"), F.col("text").alias("after"))
    # a row per task, numbers only
    order = firsts.select("next_run").withColumn("run", F.lag("next_run").over(Window.orderBy("next_run")))
    order = order.withColumn("run", F.coalesce("run", F.max("next_run").over(Window.partitionBy())))
    lasts = found.where("not first").select("id", "run", "text").join(order, "run").join(firsts, "next_run").select("id", "text", "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, [1, 2], BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0), *_figures(batch.column(1).to_pylist(), batch.column(2).to_pylist())],
                                                 names=["id", *_OUT.names])

    ends = lasts.mapInArrow(close, T.StructType([id_field, *_OUT.fields]))
    text_of = {"edited_sha256": F.lower(F.hex("edited_sha256")),
               **{c: F.translate(F.base64(c), "\r\n", "") for c in ("fingerprint", "edited_fingerprint")}}
    return found.where("run is null").select("id", *_OUT.names).unionByName(ends).withColumns(text_of).withColumnRenamed("id", id_col)
