"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Vocabulary A is a byte-level one of the ``tokenizers`` library and reads a
space and the text; B is a sentencepiece one with byte fallback and puts that
space there by itself.  Where a token of A and one of B end at the same byte,
both lists of tokens are cut; the tokens between two such places are a group,
and every token of A in it is linked with every token of B in it.

A batch of texts is worked on as Arrow columns: the ids are lists of a text,
flattened with the index of their text; byte lengths become byte ends by
cumulative sums that start anew with each text; an Acero hash join on (text,
end) finds the shared ends; ``Table.group_by`` counts the links of a text.
The number of texts that hold a pair linked is counted the same way per task
and merged by Spark.

No token of either vocabulary crosses the place before a single space between
two characters that aren't white space (for B this is read off its pieces), so
texts are cut there, and a part that was seen not long ago isn't encoded again.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import Coded, free_name, remembered, staged, text_slices

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Texts are worked on in batches of about so many bytes.
BATCH_BYTES = 2 << 20
#: Links spelt out at once, and links of one group from which on its ids are counted before they are paired.
BLOCK_LINKS, BIG_GROUP = 1 << 22, 1 << 12
#: A task hands its partial counts on when it holds so many pairs.
HELD_PAIRS = 1 << 21
#: At most so many of the most frequent pairs are broadcast with their counts; the others are looked up by a join.
HEAD_PAIRS = 1 << 19


class Vocabulary(NamedTuple):
    """Bytes of each token, and the ids of parts of texts: each is read with a space before it."""
    token: pa.Array
    encode: Callable[[list[str]], Coded]


def _flat(lists: Sequence[Sequence[int]]) -> Coded:
    return np.fromiter(chain.from_iterable(lists), dtype=np.int32), np.cumsum([0, *map(len, lists)])


#: Parts of texts of these characters only: no library or version of Unicode puts them into other classes than another.
_PLAIN = re.compile("[\n !-~\xa1-\xac\xae-\u024f]*")
#: ... that start with a space and end in none, so that those before and after them don't matter.
_REGULAR = re.compile("[!-~\xa1-\xac\xae-\u024f](?:[\n -~\xa1-\xac\xae-\u024f]*[!-~\xa1-\xac\xae-\u024f])?")


def byte_level(file: bytes) -> Vocabulary:
    """The vocabulary of a ``tokenizers`` file; special tokens in a text are plain text.

    Where its merges come in the order of their ids, plain parts of texts are
    encoded together by these ids as ranks, which gives the same ids for a
    third of the time; the ``tokenizers`` library encodes the others.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_buffer(file)
    vocabulary.encode_special_tokens = True
    byte_of = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(byte_of.values())))}
    ids = {i: t for t, i in vocabulary.get_vocab(with_added_tokens=True).items()}
    token = [bytes(byte_of[c] for c in ids.get(i, "")) for i in range(max(ids) + 1)]
    length = np.array([len(t) for t in token])
    model = json.loads(file)["model"]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ordered = {len(t) for t in token[:256]} == {1} and [model["vocab"].get(m) for m in merged] == list(range(256, 256 + len(merged))) and len(model["vocab"]) >= 256 + len(merged)
    to_ids, _ = bpe.codec({token[i]: i for i in range(256 + len(merged))}) if ordered else (None, None)

    def whole(texts: list[str]) -> Coded:
        return _flat([e.ids for e in vocabulary.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)])

    def encode(texts: list[str]) -> Coded:
        if not ordered:
            return whole(texts)
        kind = np.array([2 if _REGULAR.fullmatch(t) else 1 if _PLAIN.fullmatch(t) else 0 for t in texts])
        parts = []
        regular, plain, other = (np.flatnonzero(kind == k) for k in (2, 1, 0))
        if len(regular):
            joined = [" " + texts[i] for i in regular]
            got = to_ids("".join(joined)).astype(np.int32)
            ends = np.cumsum([len(t.encode()) for t in joined])
            parts.append((got, np.append(0, np.searchsorted(np.cumsum(length[got]), ends, side="right"))))
        if len(plain):
            parts.append(_flat([to_ids(" " + texts[i]).tolist() for i in plain]))
        if len(other):
            parts.append(whole([texts[i] for i in other]))
        if len(parts) == 1:
            return parts[0]
        lists = pa.concat_arrays([pa.ListArray.from_arrays(pa.array(s, pa.int32()), pa.array(i, pa.int32())) for i, s in parts])
        back = np.argsort(np.concatenate([regular, plain, other]), kind="stable")
        lists = lists.take(pa.array(back))
        return lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))

    return Vocabulary(pa.array(token, pa.binary()), encode)


def piece_level(file: bytes) -> Vocabulary:
    """The vocabulary of a sentencepiece model that puts a space (U+2581) before a text."""
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_proto=file)
    pieces = [vocabulary.IdToPiece(i) for i in range(vocabulary.GetPieceSize())]
    crossing = [p for i, p in enumerate(pieces) if "▁" in p.lstrip("▁") and not vocabulary.IsControl(i)]
    if crossing:
        raise ValueError(f"pieces that cross a space: {crossing[:3]}")
    token = pa.array([bytes([int(p[3:5], 16)]) if vocabulary.IsByte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(pieces)], pa.binary())
    return Vocabulary(token, lambda texts: _flat(vocabulary.encode(texts, num_threads=1)))


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Places of single spaces between two characters none of which is white space in any reading."""
    after = np.append(raw[1:], np.uint8(32))
    third = np.append(raw[2:], np.zeros(min(2, len(raw)), dtype=np.uint8))
    odd = (raw <= 32) | (raw == 127)
    wide = (raw == 0xC2) & ((after == 0x85) | (after == 0xA0))
    odd |= wide
    odd[1:] |= wide[:-1]
    # U+1680, U+180E, U+2000 to U+206F, U+2581, U+3000, U+FEFF: some library calls them white space or removes them
    wide = ((raw == 0xE1) & ((after == 0x9A) | (after == 0xA0))) | ((raw == 0xE2) & ((after == 0x80) | (after == 0x81) | (after == 0x96))) \
        | ((raw == 0xE3) & (after == 0x80) & (third == 0x80)) | ((raw == 0xEF) & (after == 0xBB))
    odd |= wide
    odd[1:] |= wide[:-1]
    odd[2:] |= wide[:-2]
    cut = raw == 32
    cut[1:] &= ~odd[:-1]
    cut[:-1] &= ~odd[1:]
    cut[:1] = cut[-1:] = False
    return np.flatnonzero(cut)


class Aligned(NamedTuple):
    """Of a batch: the tokens of all texts one after the other, by vocabulary, and where each text's begin and the last one's end.

    ``group`` numbers the groups of the batch through.  Texts without tokens hold none.
    """
    ids: tuple[np.ndarray, np.ndarray]
    starts: tuple[np.ndarray, np.ndarray]
    text: tuple[np.ndarray, np.ndarray]
    group: tuple[np.ndarray, np.ndarray]
    n_groups: np.ndarray


def aligner(a: Vocabulary, b: Vocabulary) -> Callable[[pa.StringArray], Aligned]:
    """The alignment of a batch of texts."""
    lengths = [pc.binary_length(v.token) for v in (a, b)]
    ids_of = remembered([a.encode, b.encode])

    def encoded(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Space and text of all rows as bytes, where each begins, and per vocabulary ids and their starts."""
        whole = pc.binary_join_element_wise(pa.scalar(""), pc.fill_null(texts, ""), pa.scalar(" "))
        bounds = np.frombuffer(whole.buffers()[1], dtype=np.int32)[whole.offset:whole.offset + len(whole) + 1]
        raw = np.frombuffer(whole.buffers()[2] or b"", dtype=np.uint8)[:bounds[-1]]
        begin = np.zeros(len(raw), dtype=bool)
        begin[_cuts(raw)] = begin[bounds[:-1]] = True
        begins = np.flatnonzero(begin).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, bounds[-1]).astype(np.int32)), pa.py_buffer(raw))
        once = parts.dictionary_encode()
        first = np.searchsorted(begins, bounds)
        out = []
        for lists in ids_of(pc.utf8_slice_codeunits(once.dictionary, 1)):
            taken = lists.take(once.indices)
            offsets = np.append(taken.offsets.to_numpy(), 0)
            per_text = pa.ListArray.from_arrays(pa.array(offsets[np.minimum(first, len(taken))], pa.int32()), taken.values)
            out.append(per_text)
        return raw, bounds, out

    def align(texts: pa.StringArray) -> Aligned:
        raw, bounds, lists = encoded(texts)
        has = (np.diff(bounds) > 1) & texts.is_valid().to_numpy(zero_copy_only=False)
        for v, of_text in zip((a, b), lists):
            joined = v.token.take(pc.list_flatten(of_text))
            at = np.frombuffer(joined.buffers()[1], dtype=np.int32)[:len(joined) + 1][of_text.offsets.to_numpy()]
            made = np.frombuffer(joined.buffers()[2] or b"", dtype=np.uint8)[:at[-1]]
            if not (np.array_equal(at, bounds) and np.array_equal(made, raw)):
                has &= np.array([np.array_equal(made[p:q], raw[s:e]) for p, q, s, e in zip(at[:-1], at[1:], bounds[:-1], bounds[1:])], dtype=bool)
        ids, starts, of, ends = [], [], [], []
        for of_text, length in zip(lists, lengths):
            if not has.all():
                sizes = np.where(has, of_text.value_lengths().to_numpy(), 0)
                flat = pc.list_flatten(of_text).filter(pa.array(has).take(pc.list_parent_indices(of_text)))
                of_text = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), flat)
            flat, parent = pc.list_flatten(of_text), pc.list_parent_indices(of_text).to_numpy()
            begin = of_text.offsets.to_numpy()
            total = np.append(0, pc.cumulative_sum(length.take(flat).cast(pa.int64())).to_numpy())
            ends.append((parent.astype(np.int64) << 32) + total[1:] - total[begin[:-1]][parent])
            ids.append(flat.to_numpy())
            starts.append(begin)
            of.append(parent)
        left, right = [pa.table({"end": e, at: np.arange(len(e))}) for e, at in zip(ends, ("i", "j"))]
        shared = left.join(right, "end", join_type="inner", use_threads=False)
        group = []
        for e, at in zip(ends, ("i", "j")):
            last = np.zeros(len(e), dtype=np.int64)
            last[shared[at].to_numpy()] = 1
            group.append(np.cumsum(last) - last)
        n_groups = np.bincount(of[0][shared["i"].to_numpy()], minlength=len(texts))
        return Aligned(tuple(ids), tuple(starts), tuple(of), tuple(group), n_groups)

    return align


def links(found: Aligned, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different (text << 31) + a * ``width`` + b of linked ids, ascending, and how often each is linked."""
    (a, b), (ga, gb), of = found.ids, found.group, found.text[0]
    n = int(ga[-1]) + 1 if len(ga) else 0
    in_a, in_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    big = in_a * in_b > BIG_GROUP
    partial = []

    def count(key: np.ndarray, times: np.ndarray | None = None) -> None:
        if times is None:
            got = pa.table({"key": key}).group_by("key", use_threads=False).aggregate([([], "count_all")]).rename_columns(["key", "n"])
        else:
            got = pa.table({"key": key, "n": times})
        partial.append(got)

    rows = np.flatnonzero(~big[ga]) if big.any() else np.arange(len(ga))
    each = in_b[ga[rows]]
    upto = np.cumsum(each)
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_LINKS, side="right")))
        i, m = rows[at:end], each[at:end]
        left = np.repeat(i, m)
        j = np.repeat(first_b[ga[i]], m) + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
        count((of[left].astype(np.int64) << 31) + a[left].astype(np.int64) * width + b[j])
        at = end
    for g in np.flatnonzero(big):
        one, n_one = np.unique(a[first_a[g]:first_a[g] + in_a[g]], return_counts=True)
        two, n_two = np.unique(b[first_b[g]:first_b[g] + in_b[g]], return_counts=True)
        step, base = max(1, BLOCK_LINKS // len(two)), np.int64(of[first_a[g]]) << 31
        for s in range(0, len(one), step):
            key = one[s:s + step, None].astype(np.int64) * width + two[None, :]
            count(base + key.ravel(), (n_one[s:s + step, None] * n_two[None, :]).ravel())
    if not partial:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    got = partial[0] if len(partial) == 1 else \
        pa.concat_tables([p.cast(pa.schema([("key", pa.int64()), ("n", pa.int64())])) for p in partial]) \
        .group_by("key", use_threads=False).aggregate([("n", "sum")]).rename_columns(["key", "n"])
    key, times = got["key"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(key)
    return key[order], times[order].astype(np.int64)


def speller(sizes: tuple[int, int]) -> Callable[[Aligned], list[str]]:
    """SHA-256 of each text's groups, written ``a1,a2|b1;a3|b2,b3`` ('' for a text without tokens)."""
    marked = [pa.array([f"{i}{mark}" for mark in marks for i in range(size)]) for size, marks in zip(sizes, ((",", "|"), (",", ";", "")))]
    table = pa.concat_arrays(marked)

    def digests(found: Aligned) -> list[str]:
        (ga, gb), (a, b) = found.group, found.ids
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[:len(g)] for g in (ga, gb))
        ends = found.starts[1][1:][np.diff(found.starts[1]) > 0] - 1
        variant = last_b.astype(np.int64)
        variant[ends] = 2
        n = int(ga[-1]) + 1 if len(ga) else 0
        in_a, in_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        order = np.empty(len(ga) + len(gb), dtype=np.int64)
        order[np.arange(len(ga)) + (np.cumsum(in_b) - in_b)[ga]] = last_a * sizes[0] + a
        order[np.arange(len(gb)) + np.cumsum(in_a)[gb]] = 2 * sizes[0] + variant * sizes[1] + b
        text = table.take(pa.array(order))
        at = np.frombuffer(text.buffers()[1], dtype=np.int32)[:len(text) + 1][found.starts[0] + found.starts[1]]
        raw = memoryview(text.buffers()[2] or b"")
        return [hashlib.sha256(raw[s:e]).hexdigest() if e > s else "" for s, e in zip(at[:-1].tolist(), at[1:].tolist())]

    return digests


def _read(*paths: str) -> list[bytes]:
    files = []
    for path in paths:
        with open(path, "rb") as f:
            files.append(f.read())
    return files


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))


def _mapped(docs: DataFrame, text_col: str, new: dict[str, T.DataType], columns: Callable[[Vocabulary, Vocabulary], Callable],
            a_path: str, b_path: str, keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns ``new`` that ``columns(a, b)`` makes of each aligned batch."""
    gone = {x.lower() for x in new} | (set() if keep_text else {text_col.lower()})
    keep = [i for i, c in enumerate(docs.columns) if c.lower() not in gone]
    fields = [docs.schema.fields[i] for i in keep] + [T.StructField(c, t) for c, t in new.items()]
    at, names = docs.columns.index(text_col), [f.name for f in fields]
    files = docs.sparkSession.sparkContext.broadcast(_read(a_path, b_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        a, b = byte_level(files.value[0]), piece_level(files.value[1])
        align, of = aligner(a, b), columns(a, b)
        for whole in batches:
            for batch in text_slices(whole, [at], BATCH_BYTES):
                made = of(align(batch.column(at).cast(pa.string())))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + made, names=names)

    return docs.mapInArrow(run, T.StructType(fields))


def align(docs: DataFrame, text_col: str = "text", a_path: str = BYTE_LEVEL, b_path: str = PIECES) -> DataFrame:
    """``docs`` with arrays ``a_ids``, ``b_ids`` and, as long, ``a_groups``, ``b_groups``: each token's group, from 0.

    Texts that are NULL or empty, or whose tokens of A or B don't join to a
    space and the text (U+2581 in a text), have empty arrays.  Every row
    stays; columns of these four names are replaced.
    """
    def columns(a: Vocabulary, b: Vocabulary):
        def made(found: Aligned) -> list[pa.Array]:
            base = np.cumsum(found.n_groups) - found.n_groups
            groups = [g - base[of] for g, of in zip(found.group, found.text)]
            return [_lists(v, s) for v, s in zip((*found.ids, *groups), found.starts * 2)]

        return made

    ints = T.ArrayType(T.IntegerType())
    return _mapped(docs, text_col, {c: ints for c in ("a_ids", "b_ids", "a_groups", "b_groups")}, columns, a_path, b_path)


#: What ``linked`` adds to a row: figures, digest, the different linked ids and how often each pair is linked.
FIGURES = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups_sha256": T.StringType(),
           "pair_a": T.ArrayType(T.IntegerType()), "pair_b": T.ArrayType(T.IntegerType()), "pair_n": T.ArrayType(T.IntegerType())}


def linked(docs: DataFrame, text_col: str = "text", a_path: str = BYTE_LEVEL, b_path: str = PIECES, keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns FIGURES: counts, the digest of the groups, and the different linked pairs of each text."""
    def columns(a: Vocabulary, b: Vocabulary):
        spell, width = speller((len(a.token), len(b.token))), len(b.token)

        def made(found: Aligned) -> list[pa.Array]:
            key, times = links(found, width)
            rows = len(found.n_groups)
            starts = np.searchsorted(key >> 31, np.arange(rows + 1))
            pair = key & (1 << 31) - 1
            total = np.append(0, np.cumsum(times))
            counts = [np.diff(found.starts[0]), np.diff(found.starts[1]), found.n_groups, total[starts[1:]] - total[starts[:-1]]]
            return [pa.array(c.astype(np.int64)) for c in counts] + [pa.array(spell(found), pa.string())] + \
                [_lists(v, starts) for v in (pair // width, pair % width, times)]

        return made

    return _mapped(docs, text_col, FIGURES, columns, a_path, b_path, keep_text)


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n) over all rows of ``found`` (see ``linked``): how many rows hold the pair linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        held, waiting, rows = None, [], 0

        def merged() -> pa.Table:
            new = pa.concat_tables(waiting).group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["a", "b", "n"])
            if held is None:
                return new
            return pa.concat_tables([held, new]).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])

        for batch in batches:
            waiting.append(pa.table({"a": pc.list_flatten(batch.column(0)), "b": pc.list_flatten(batch.column(1))}))
            rows += waiting[-1].num_rows
            if rows >= HELD_PAIRS:
                held, waiting, rows = merged(), [], 0
                if held.num_rows >= HELD_PAIRS:
                    yield from held.to_batches()
                    held = None
        if waiting:
            held = merged()
        if held is not None:
            yield from held.to_batches()

    partial = found.select("pair_a", "pair_b").mapInArrow(run, "a int, b int, n long")
    return partial.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least count of a pair in the head, and the head's a, b and counts: the pairs of the highest counts, ``most`` at most."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    sizes = {r.level: (r.n, r.least) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("n").alias("least")).collect()}
    least, room = None, most
    for _, (n, low) in sorted(sizes.items(), reverse=True):
        if n > room:
            break
        least, room = low, room - n
    if least is None:
        return 1 << 62, *[np.zeros(0, dtype=np.int64)] * 3
    rows = counts.where(F.col("n") >= F.lit(least)).toPandas()
    return least, *[rows[c].to_numpy(dtype=np.int64) for c in ("a", "b", "n")]


def valued(found: DataFrame, counts: DataFrame, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """``found`` (see ``linked``) without its pairs, with ``n_best`` and ``count_sum``; pass staged tables.

    ``n_best``: links whose pair has the highest count of all pairs of its A
    id, ties included; ``count_sum``: sum of the counts over all links.  The
    counts of at most ``head_pairs`` most frequent pairs are broadcast, and
    the highest count of each A id (bounded by the vocabulary); the links of
    all other pairs meet their counts in a join, none of whose keys is
    frequent.
    """
    least, a, b, n = _head(counts, head_pairs)
    top = counts.groupBy("a").agg(F.max("n").alias("n")).toPandas()
    best = np.zeros(int(top["a"].max()) + 1 if len(top) else 0, dtype=np.int64)
    best[top["a"].to_numpy(dtype=np.int64)] = top["n"].to_numpy(dtype=np.int64)
    key = a << 32 | b
    order = np.argsort(key)
    held = found.sparkSession.sparkContext.broadcast((key[order], n[order], best))
    row, of_row, here_best, here_sum, more_best, more_sum = (free_name(found.columns, f"__{x}") for x in (
        "row", "of_row", "best", "sum", "more_best", "more_sum"))
    pairs = ("pair_a", "pair_b", "pair_n")
    keep = [i for i, c in enumerate(found.columns) if c not in pairs]
    at = [found.columns.index(c) for c in pairs]
    names = [found.columns[i] for i in keep] + [here_best, here_sum, *pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        keys, counted, highest = held.value
        for batch in batches:
            parent = pc.list_parent_indices(batch.column(at[0])).to_numpy()
            one, two, times = (pc.list_flatten(batch.column(i)).to_numpy().astype(np.int64) for i in at)
            want = one << 32 | two
            place = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            known = keys[place] == want if len(keys) else np.zeros(len(want), dtype=bool)
            worth = np.where(known, counted[place] if len(keys) else 0, 0)
            upto = [np.append(0, np.cumsum(x)) for x in (times * (known & (worth == highest[one])), times * worth)]
            bounds = np.searchsorted(parent, np.arange(batch.num_rows + 1))
            sums = [pa.array(u[bounds[1:]] - u[bounds[:-1]]) for u in upto]
            rest = ~known
            starts = np.searchsorted(parent[rest], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + sums + [_lists(x[rest], starts) for x in (one, two, times)], names=names)

    fields = [found.schema.fields[i] for i in keep] + [T.StructField(c, T.LongType()) for c in (here_best, here_sum)] + \
        [found.schema[c] for c in pairs]
    out = staged(found.mapInArrow(run, T.StructType(fields)).withColumn(row, F.monotonically_increasing_id()), "aligned-head")
    top_of = found.sparkSession.createDataFrame(top, "a int, n long").select(F.col("a").alias("top_a"), F.col("n").alias("top"))
    rare = counts.where(F.col("n") < F.lit(least)).join(F.broadcast(top_of), F.col("a") == F.col("top_a")).select("a", "b", "n", "top")
    zipped = F.explode(F.arrays_zip(*[F.col(c) for c in pairs]))
    links_of = out.select(F.col(row).alias(of_row), zipped.alias("p")).select(of_row, *[F.col(f"p.{c}") for c in pairs])
    sums = links_of.join(rare, (F.col("pair_a") == F.col("a")) & (F.col("pair_b") == F.col("b"))).groupBy(of_row).agg(
        F.sum(F.when(F.col("n") == F.col("top"), F.col("pair_n")).otherwise(0)).alias(more_best), F.sum(F.col("pair_n") * F.col("n")).alias(more_sum))
    out = out.drop(*pairs).join(sums, F.col(row) == F.col(of_row), "left")
    given = [F.col(f"`{c}`") for c in found.columns if c not in (*pairs, "n_best", "count_sum")]
    return out.select(*given, (F.col(here_best) + F.coalesce(more_best, F.lit(0))).alias("n_best"),
                      (F.col(here_sum) + F.coalesce(more_sum, F.lit(0))).alias("count_sum"))


def alignment_figures(docs: DataFrame, text_col: str = "text", a_path: str = BYTE_LEVEL, b_path: str = PIECES) -> DataFrame:
    """``docs`` without its texts, with counts, links, their corpus-wide worth and the digest of the groups.

    Every row stays, rows with equal ids too; a text counts once per row it
    stands in.  Texts without tokens (see ``align``) have zeros and ''.  An
    empty table gives no rows.
    """
    found = staged(linked(docs, text_col, a_path, b_path, keep_text=False), "aligned")
    return valued(found, staged(pair_counts(found), "pair-counts"))
