"""Byte-level BPE: texts to token ids and back with the tiktoken library.

The rank file is read once on the driver and broadcast (one to two MB), so
executors need the library but no copy of the file.  Long texts are cut at
places where the split pattern has a boundary whatever stands around it -- a
space or line feed after a letter or digit -- so the ids are those of the
whole text while each call to the library sees a bounded piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Cut texts into pieces of about so many characters.
PIECE = 1 << 16
#: The library's pattern overflows its stack on white space of about a million characters; runs beyond this are its own pieces.
LONG_RUN = 1 << 16
#: What the pattern's \\s matches (Unicode White_Space; Python's has four control characters more).
_SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Give batches of about so many bytes of text back to Spark.
BATCH_BYTES = 4 << 20

#: From a text's ids and decoded bytes, a value of the Spark type.
Derived = tuple[T.DataType, Callable[[np.ndarray, bytes], object]]
#: Count of ids, digest of the ids as little-endian unsigned 32-bit integers, digest of the decoded bytes.
DIGESTS: dict[str, Derived] = {
    "n_tokens": (T.LongType(), lambda ids, raw: len(ids)),
    "ids_sha256": (T.StringType(), lambda ids, raw: hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()),
    "decoded_sha256": (T.StringType(), lambda ids, raw: hashlib.sha256(raw).hexdigest()),
}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Consecutive parts of ``text``, cut at safe boundaries only; a part is longer than ``size`` where none comes."""
    if len(text) <= size:
        yield text
        return
    cut, at = re.compile(r"[^\W_](?=[ \n])"), 0
    while at < len(text):
        found = cut.search(text, at + size - 1)
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def long_runs(text: str, longest: int) -> Iterator[tuple[str, bool]]:
    """Consecutive parts of ``text``, and whether each is white space that the pattern takes in one match.

    A run of over ``longest`` characters is one match but for its last one,
    which the pattern leaves to what follows, if anything does.
    """
    at = 0
    if len(text) > longest:
        for run in re.finditer(_SPACE + "{%d,}" % (longest + 1), text):
            end = run.end() - (run.end() < len(text))
            if run.start() > at:
                yield text[at:run.start()], False
            yield text[run.start():end], True
            at = end
    if at < len(text) or not text:
        yield text[at:], False


def _encoding(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def codec(ranks: dict[bytes, int]) -> tuple[Callable[[str | None], np.ndarray], Callable[[np.ndarray], bytes]]:
    """Both ways: a text's ids, and the bytes of ids."""
    encoding = _encoding(ranks)
    token = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        token[rank] = piece

    def encode(text: str | None) -> np.ndarray:
        parts = [np.asarray(encoding._encode_single_piece(part), dtype=np.uint32) if run
                 else encoding.encode_to_numpy(part, disallowed_special=())
                 for p in pieces(text or "") for part, run in long_runs(p, LONG_RUN)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(ids: np.ndarray) -> bytes:
        return b"".join([token[i] for i in ids.tolist()])

    return encode, decode


def _mapped(df: DataFrame, fields: dict[str, T.DataType], values: Callable[[dict], Callable[[object], tuple]],
            ranks_path: str, of: str, drop: Sequence[str] = ()) -> DataFrame:
    """``df`` without ``drop`` and with columns ``fields``, made by ``values(ranks)`` from each value of the column ``of``."""
    gone = {x.lower() for x in [*fields, *drop]}
    keep = [f for f in df.schema.fields if f.name.lower() not in gone]
    at = df.columns.index(of)
    held = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    types = [to_arrow_type(t) for t in fields.values()]
    names = [f.name for f in keep] + list(fields)
    kept_at = [df.schema.fields.index(f) for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = values(held.value)
        for batch in batches:
            start, size, rows = 0, 0, []
            for i, value in enumerate(batch.column(at)):
                value = value.as_py()
                rows.append(one(value))
                size += len(value) if value is not None else 0
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(start, len(rows))
                    new = [pa.array(column, type=t) for column, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays([part.column(k) for k in kept_at] + new, names=names)
                    start, size, rows = i + 1, 0, []

    return df.mapInArrow(run, T.StructType([*keep, *[T.StructField(n, t) for n, t in fields.items()]]))


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of the whole text (array<int>; NULL and empty texts: no ids).

    Every row stays, repeated rows too; a column named ``ids_col`` is
    replaced and all others are handed through.  No special tokens.
    """
    def values(ranks):
        to_ids, _ = codec(ranks)
        return lambda text: (to_ids(text).astype(np.int32),)

    return _mapped(docs, {ids_col: T.ArrayType(T.IntegerType())}, values, ranks_path, text_col)


def decode(docs: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with the raw bytes of its ids (binary; NULL ids: no bytes).

    Bytes, not text: ids need not end on a character.  An id that the rank
    file doesn't have fails.
    """
    def values(ranks):
        _, to_bytes = codec(ranks)
        return lambda ids: (to_bytes(np.asarray(ids or [], dtype=np.int64)),)

    return _mapped(docs, {bytes_col: T.BinaryType()}, values, ranks_path, ids_col)


def encode_decode(docs: DataFrame, ranks_path: str, derive: dict[str, Derived], text_col: str = "text",
                  keep_text: bool = True) -> DataFrame:
    """Both ways in one pass over the texts: ``docs`` with a column for each of ``derive``.

    A derived column is a Spark type and a function of a text's ids (uint32)
    and decoded bytes, so ids that only feed a count or a digest never leave
    the Python worker.  Rows and other columns as for ``encode``.
    """
    functions = [f for _, f in derive.values()]

    def values(ranks):
        to_ids, to_bytes = codec(ranks)

        def one(text):
            ids = to_ids(text)
            raw = to_bytes(ids)
            return tuple(f(ids, raw) for f in functions)

        return one

    return _mapped(docs, {n: t for n, (t, _) in derive.items()}, values, ranks_path, text_col,
                   () if keep_text else (text_col,))
