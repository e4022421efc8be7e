"""Quality rules from base counts and from tokeniser fertility.

Four public vocabularies read the words of each text, each word by itself: a
sentencepiece one with byte fallback, two byte-level ones and one with word
ends.  Each gives characters per token and the entropy of the tokens relative
to the most that so many tokens could have, the first also the share of
tokens that are fallback bytes.  Rejection bands per language (per script where no
language is given) follow from the quartiles of these figures over all
documents, so they need no list of languages:

* characters per token below or above the band (garbled, shouted, mark-up
  ridden text falls apart into short tokens),
* byte-fallback share above its band (symbols, wrong encodings),
* token entropy below its band (one phrase over and over).

A text outside the band of any vocabulary goes.

An address, a number or a quotation in an otherwise clean text shifts the
figures by its share of the tokens, so short texts are held against the
quartiles of texts of their length: a length class is a power of two of
words.  A class of under ``LEAST_CLASS`` texts takes the language's quartiles,
widened for short texts up to ``MOST_WIDER`` times.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import Coded, free_name, remembered, staged, text_slices

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: The other public vocabularies; byte_bpe_50k.json is that of the rank file again.
OTHERS = {"byte": public_tokenizers.path("byte_bpe_50k.tiktoken"), "multi": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
          "word": public_tokenizers.path("word_bpe_49k.json")}
#: Texts are measured in batches of about so many bytes.
BATCH_BYTES = 2 << 20
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
#: A base rule fails above this percentage of words in repeated windows.
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Half-width of a band in interquartile ranges, and the least half-width of each figure.
BAND = 2.0
LEAST_CLASS, MOST_WIDER = 10, 3.0
FIGURES = {"chars_per_token": 0.1, "byte_share": 0.05, "token_entropy": 0.1} \
    | {f"{x}_{v}": least for v in OTHERS for x, least in (("chars_per_token", 0.1), ("token_entropy", 0.1))}
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63],
                        dtype=np.uint64)

MEASURES = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("chars_per_token", T.DoubleType()), T.StructField("byte_share", T.DoubleType()),
    T.StructField("token_entropy", T.DoubleType()),
    *[T.StructField(f"{x}_{v}", T.DoubleType()) for v in OTHERS for x in ("chars_per_token", "token_entropy")],
    T.StructField("script", T.StringType())])


def repeated_words(codes: np.ndarray, text: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each word whether it lies in a window of ``window`` words found twice or more in its text, its first place included.

    ``codes``: equal for equal words; ``text``: the number of each word's text, ascending.
    """
    n = max(len(codes) - window + 1, 0)
    inside = text[:n] == text[window - 1:]
    mixed = text[:n].astype(np.uint64) * _MULTIPLIERS[0]
    for k in range(window):
        mixed = (mixed ^ codes[k:k + n].astype(np.uint64)) * _MULTIPLIERS[k]
        mixed ^= mixed >> np.uint64(31)
    at = np.flatnonzero(inside)
    order = at[np.argsort(mixed[at], kind="stable")]
    same = mixed[order][1:] == mixed[order][:-1]
    again = np.zeros(len(order), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    marks = np.zeros(len(codes) + 1, dtype=np.int64)
    marks[order[again]] += 1
    np.subtract.at(marks, order[again] + window, 1)
    return np.cumsum(marks)[:-1] > 0


class Counts(NamedTuple):
    """Base counts of some texts, and their words: the different ones, the code of each and the number of its text."""
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    words: pa.Array
    codes: np.ndarray
    text: np.ndarray


def batch_counts(texts: Sequence[str]) -> Counts:
    """Words; their characters; symbols; lines equal to an earlier line with a word; words in repeated windows."""
    words, n_words, spaces, symbols, dups = [], [], [], [], []
    for text in texts:
        raw = text.encode()
        found = raw.split()  # bytes.split() cuts at exactly the six ASCII spaces
        words += found
        n_words.append(len(found))
        spaces.append(len(text) - len(raw))
        symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
        lines = [line for line in raw.split(b"\n") if line.strip()]
        dups.append(len(lines) - len(set(lines)))
    n_words = np.array(n_words, dtype=np.int64)
    column = pa.array(words, pa.binary())
    once = column.dictionary_encode()
    codes, text = once.indices.to_numpy(), np.repeat(np.arange(len(texts)), n_words)
    upto = np.append(0, np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64)))
    ends = np.cumsum(n_words)
    # characters of the words: their bytes, less what the whole text has more bytes than characters
    chars = upto[ends] - upto[ends - n_words] + np.array(spaces, dtype=np.int64)
    repeats = np.bincount(text[repeated_words(codes, text)], minlength=len(texts))
    return Counts(n_words, chars, np.array(symbols, dtype=np.int64), np.array(dups, dtype=np.int64), repeats,
                  once.dictionary.cast(pa.string()), codes, text)


def base_counts(text: str) -> tuple[list[bytes], int, int, int, int]:
    """Words and base counts of one text."""
    found = batch_counts([text])
    return (text.encode().split(), *(int(c[0]) for c in found[1:5]))


def _script(text: str) -> str:
    """First word of the Unicode name of the text's first letter ('LATIN', 'CJK', ...); '' without letters."""
    letter = re.search(r"[^\W\d_]", text)
    return unicodedata.name(letter[0], "").partition(" ")[0] if letter else ""


def _read(model_path: str = VOCABULARY) -> tuple[bytes, dict[str, bytes]]:
    """The files of all vocabularies."""
    files = []
    for path in (model_path, *OTHERS.values()):
        with open(path, "rb") as f:
            files.append(f.read())
    return files[0], dict(zip(OTHERS, files[1:]))


def _cat(lists: Sequence[Sequence[int]]) -> Coded:
    ids = np.fromiter(chain.from_iterable(lists), dtype=np.int32)
    return ids, np.cumsum([0, *map(len, lists)])


def _piece_encoder(file: bytes):
    """Encoder of words by the sentencepiece vocabulary, and which of its ids are fallback bytes."""
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_proto=file)
    is_byte = np.array([vocabulary.IsByte(i) for i in range(vocabulary.GetPieceSize())])
    return lambda words: _cat(vocabulary.encode(words, num_threads=1)), is_byte


def _rank_encoder(file: bytes) -> Callable[[list[str]], Coded]:
    """Encoder of words, each read with a space before it, by the ranks of a file."""
    ranks = bpe.parse_ranks(file)
    encode, _ = bpe.codec(ranks)
    leads = np.zeros(max(ranks.values()) + 1, dtype=bool)
    leads[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True

    def coded(words: list[str]) -> Coded:
        text = " ".join(words)
        if len(text.split()) == len(words):  # else white space of two words could meet
            ids = encode(" " + text)
            starts = np.flatnonzero(leads[ids])
            if len(starts) == len(words):
                return ids.astype(np.int32), np.append(starts, len(ids))
        return _cat([encode(" " + word).tolist() for word in words])

    return coded


def _word_encoder(file: bytes) -> Callable[[list[str]], Coded]:
    """Encoder of words by the vocabulary with word ends, as ``tokenizers`` does it at several times the cost.

    A zero byte stands for the word end: joining a byte to it has a lower
    rank than any merge.  Zero bytes and ones of the text are read as twos.
    """
    import regex
    import tiktoken

    vocabulary = json.loads(file)
    byte_of = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(byte_of.values())))}
    special = {t["content"] for t in vocabulary["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>"): i
             for t, i in vocabulary["model"]["vocab"].items() if t not in special}
    encoding = tiktoken.Encoding("word", pat_str=r"[^\x00\x01]+\x00|\x01", mergeable_ranks=ranks, special_tokens={})
    split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}\x01]+|\x01")
    mark, plain = ranks[b"\1"], {0: 2, 1: 2}

    def coded(words: list[str]) -> Coded:
        text = "\1".join(words) + "\1"
        if "\0" in text or text.count("\1") > len(words):
            text = "".join([word.translate(plain) + "\1" for word in words])
        text = "\0".join(split.findall(unicodedata.normalize("NFC", text).lower()))
        ids = encoding.encode_to_numpy(text.replace("\1\0", "\1"), disallowed_special=()).astype(np.int32)
        ends = np.flatnonzero(ids == mark)
        return np.delete(ids, ends), np.append(0, ends - np.arange(len(ends)))

    return coded


def _batch_measurer(model: bytes, others: dict[str, bytes]) -> Callable[[Sequence[str]], list[np.ndarray | list]]:
    """The columns of MEASURES for a batch of texts.

    No token crosses a space, so a word has the same ids wherever it stands:
    each different word of a batch is encoded once, all words together.
    """
    pieces, is_byte = _piece_encoder(model)
    ids_of = remembered([pieces, *[(_word_encoder if v == "word" else _rank_encoder)(file) for v, file in others.items()]])

    def measure(texts: Sequence[str]) -> list[np.ndarray | list]:
        n, base = len(texts), batch_counts(texts)
        pair, times = np.unique(base.text * np.int64(max(len(base.words), 1)) + base.codes, return_counts=True)
        text, word = np.divmod(pair, max(len(base.words), 1))
        figures, bytes_of = [], None
        for lists in ids_of(base.words):
            taken = lists.take(pa.array(word))
            sizes = taken.value_lengths().to_numpy()
            key = np.repeat(text << 32, sizes) | taken.flatten().to_numpy()
            used = pa.table({"key": key, "n": np.repeat(times, sizes)}).group_by("key", use_threads=False).aggregate([("n", "sum")])
            key, count = used["key"].to_numpy(), used["n_sum"].to_numpy()
            of = key >> 32
            total = np.bincount(of, weights=count, minlength=n)
            spread = np.bincount(of, weights=count * np.log2(count), minlength=n)
            several = np.maximum(total, 2)
            entropy = np.where(total < 2, 1.0, (np.log2(several) - spread / several) / np.log2(several))
            figures += [np.where(total > 0, base.word_chars / np.maximum(total, 1), 0.0), entropy]
            if bytes_of is None:
                some = is_byte[key & 0xFFFFFFFF]
                bytes_of = total.astype(np.int64), np.bincount(of[some], weights=count[some], minlength=n) / np.maximum(total, 1)
        n_tokens, byte_share = bytes_of
        return [*base[:5], n_tokens, figures[0], byte_share, *figures[1:], list(map(_script, texts))]

    return measure


def _measurer(model: bytes, others: dict[str, bytes] | None = None) -> Callable[[str], tuple]:
    """The measures of one text at a time."""
    measure = _batch_measurer(model, _read()[1] if others is None else others)
    return lambda text: tuple(column[0] for column in measure([text]))


def measured(docs: DataFrame, text_col: str = "text", into: str = "measures", model_path: str = VOCABULARY) -> DataFrame:
    """``docs`` with a struct of the base counts and token figures of the whole text (NULL: of an empty one).

    The vocabulary files are read on the driver and broadcast (under four megabytes).
    """
    files = docs.sparkSession.sparkContext.broadcast(_read(model_path))
    at, names = docs.columns.index(text_col), [*docs.columns, into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        measure = _batch_measurer(*files.value)
        for whole in batches:
            for batch in text_slices(whole, [at], BATCH_BYTES):
                columns = measure([text or "" for text in batch.column(at).to_pylist()])
                struct = pa.StructArray.from_arrays(
                    [pa.array(c, {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()])
                     for c, f in zip(columns, MEASURES.fields)], names=MEASURES.names)
                yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, MEASURES)]))


def group_of(lang: Column | None, script: Column) -> Column:
    """The group whose bands hold: the language, else the script in brackets."""
    by_script = F.concat(F.lit("("), script, F.lit(")"))
    return by_script if lang is None else F.coalesce(lang.cast("string"), by_script)


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}.n_words"))


def length_class(m: str) -> Column:
    """Number of binary digits of the number of words."""
    return F.length(F.bin(F.col(f"{m}.n_words")))


def bands(frame: DataFrame, group: Column, m: str) -> DataFrame:
    """Per group and length class: the quartiles of each figure over all texts that pass the base rules.

    A row of class NULL holds for the whole group, and for its classes of
    under ``LEAST_CLASS`` texts, with the group's median number of tokens.
    """
    figures = [F.percentile_approx(f"{m}.{x}", [0.25, 0.75], 10000).alias(f"{m}_{x}") for x in FIGURES]
    good = frame.where(~base_failed(m)).withColumn(f"{m}_of", group)
    whole = good.groupBy(f"{m}_of").agg(F.percentile_approx(f"{m}.n_tokens", 0.5, 10000).alias(f"{m}_typical"), *figures)
    classes = good.groupBy(f"{m}_of", length_class(m).alias(f"{m}_length")).agg(F.count("*").alias("n"), *figures)
    return whole.withColumn(f"{m}_length", F.lit(None).cast("int")).unionByName(
        classes.where(F.col("n") >= LEAST_CLASS).drop("n").withColumn(f"{m}_typical", F.lit(None).cast("long")))


def in_bands(m: str) -> Column:
    """True where every figure lies in the joined band (or where there is no band)."""
    wider = F.least(1 + F.col(f"{m}_typical") / (3 * F.greatest(F.col(f"{m}.n_tokens"), F.lit(1))), F.lit(MOST_WIDER))
    wider = F.when(F.col(f"{m}_typical").isNull(), 1.0).otherwise(wider)

    def sides(x: str) -> tuple[Column, Column, Column]:
        q = F.col(f"{m}_{x}")
        half = F.greatest((q[1] - q[0]) * BAND, F.lit(FIGURES[x])) * wider
        return F.col(f"{m}.{x}"), q[0] - half, q[1] + half

    inside = F.lit(True)
    for x in FIGURES:
        value, low, high = sides(x)
        if not x.startswith("byte_share"):
            inside &= value >= low
        if not x.startswith("token_entropy"):
            inside &= value <= high
    return F.coalesce(inside, F.lit(True))


def judged(frame: DataFrame, m: str, lang_col: str | None = "lang") -> DataFrame:
    """``frame`` (see ``measured``; pass a staged table, it is read twice) with booleans ``{m}_failed`` and ``{m}_kept``.

    ``{m}_failed``: a base rule fails; ``{m}_kept``: none does and all figures
    lie in their bands.  Every row stays, whatever is NULL in it: a NULL text
    has no words and fails, a NULL language is judged with its script.
    """
    group = group_of(F.col(lang_col) if lang_col else None, F.col(f"{m}.script"))
    # Written first: a table of a few rows whose known size lets the joins broadcast it.
    limits = staged(bands(frame, group, m), "bands")
    kinds = limits.where(F.col(f"{m}_length").isNotNull()).select(f"{m}_of", f"{m}_length")
    out = frame.withColumns({f"{m}_group": group, f"{m}_class": length_class(m)})
    held = out.join(kinds, (F.col(f"{m}_group") == F.col(f"{m}_of")) & (F.col(f"{m}_class") == F.col(f"{m}_length")), "left") \
        .withColumn(f"{m}_class", F.col(f"{m}_length")).drop(f"{m}_of", f"{m}_length")
    out = held.join(limits, (F.col(f"{m}_group") == F.col(f"{m}_of")) & F.col(f"{m}_class").eqNullSafe(F.col(f"{m}_length")), "left")
    out = out.withColumn(f"{m}_failed", base_failed(m)).withColumn(f"{m}_kept", ~base_failed(m) & in_bands(m))
    return out.drop(f"{m}_group", f"{m}_class", f"{m}_of", f"{m}_length", f"{m}_typical", *[f"{m}_{x}" for x in FIGURES])


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", model_path: str = VOCABULARY) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns; whatever they are called, none is overwritten."""
    m = free_name(docs.columns, "measures")
    frame = staged(measured(docs, text_col, m, model_path), "measured")
    return judged(frame, m, lang_col).where(F.col(f"{m}_kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
