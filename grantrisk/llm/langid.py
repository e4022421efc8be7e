"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language over all training documents:
each task adds up the batches it reads and emits its non-zero counts, which
are summed by (language, feature).  The log-probability matrix has
``2 ** bits`` rows and a column per language, a size that doesn't depend on
the corpus, and is broadcast.  Scoring sums matrix rows over a text's n-grams in
numpy, several texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

#: At most so many languages; more would not be language codes.
MAX_LANGUAGES = 1024
#: Score about so many characters at a time.
BLOCK = 1 << 20
_SPACE = 32
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


@dataclass(frozen=True)
class Model:
    """log_prob: (2 ** bits, languages) float32; log_prior: (languages,)."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray
    bits: int
    orders: tuple[int, ...]


def letter_table() -> np.ndarray:
    """Which code points are letters (1.1 MB, made on the driver and broadcast)."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def features(text: str, letters: np.ndarray, bits: int, orders: tuple[int, ...]) -> np.ndarray:
    """Hashed n-grams (uint32 below 2 ** bits) of the lower-cased text with a space around it.

    Characters that aren't letters all count as a space, so digits, symbols
    and line structure say nothing about the language.
    """
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    chars = np.where(letters[chars], chars, _SPACE)
    chars = np.concatenate(([_SPACE], chars, [_SPACE])).astype(np.uint64)
    out = []
    for n in orders:
        if len(chars) < n:
            continue
        h = np.zeros(len(chars) - n + 1, dtype=np.uint64)
        for k in range(n):
            h += chars[k:len(chars) - n + 1 + k] * np.uint64(_MULTIPLIERS[k] + 2 * n)
        h ^= h >> np.uint64(29)
        out.append(((h * np.uint64(_MULTIPLIERS[3])) >> np.uint64(64 - bits)).astype(np.uint32))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = 16,
        orders: tuple[int, ...] = (1, 2, 3), alpha: float = 0.5) -> Model:
    """Fit on every row of ``docs`` whose text and language aren't NULL.

    Without such rows the model has no language.  Priors are the shares of
    the training documents, smoothed by one document per language.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    width = 1 << bits
    held = docs.sparkSession.sparkContext.broadcast(letter_table())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def add(lang: str) -> None:
            sums[lang][:width] += np.bincount(np.concatenate(waiting.pop(lang)), minlength=width)

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                text, lang = text.as_py(), lang.as_py()
                sums.setdefault(lang, np.zeros(width + 1, dtype=np.int64))[width] += 1
                for at in range(0, len(text), BLOCK):
                    block = waiting.setdefault(lang, [])
                    block.append(features(text[at:at + BLOCK], held.value, bits, orders))
                    if len(block) >= 256 or len(block[-1]) >= BLOCK // 4:
                        add(lang)
        for lang in list(waiting):
            add(lang)
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(total[used])],
                names=["lang", "feature", "n"])

    counts = rows.mapInArrow(count, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counts = staged(counts, "language-counts")  # read twice below
    languages = sorted(r.lang for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    table = counts.toPandas()  # at most languages * (2 ** bits + 1) rows
    n = np.zeros((width + 1, len(languages)))
    if languages:
        n[table["feature"].to_numpy(), table["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()] = table["n"].to_numpy()
    seen, documents = n[:width] + alpha, n[width] + 1
    return Model(tuple(languages), np.log(seen / seen.sum(axis=0)).astype(np.float32), np.log(documents / documents.sum()), bits, orders)


def predict(docs: DataFrame, model: Model, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_cols`` of every row with ``lang_pred`` and ``score``, from the text alone.

    ``lang_pred`` is the language of the highest posterior (the first in
    alphabetical order on a tie), ``score`` its posterior.  Texts that are
    NULL or have no letter, and all texts under a model without languages,
    get ``und`` with score 0.  Whole texts count, in blocks for long ones.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_prob, model.log_prior, letter_table()))
    bits, orders = model.bits, model.orders
    rows = docs.select(*[F.col(c) for c in id_cols], F.col(text_col).cast("string").alias("__text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, log_prob, log_prior, letters = held.value
        matrix = log_prob.astype(np.float64)
        for batch in batches:
            texts = batch.column(len(id_cols)).to_pylist()
            logs = np.tile(log_prior, (len(texts), 1)) if languages else np.zeros((len(texts), 1))
            wanted = [i for i, t in enumerate(texts) if t and languages and has_letter(t)]
            blocks = [(i, texts[i][at:at + BLOCK]) for i in wanted for at in range(0, len(texts[i]), BLOCK)]
            start = 0
            while start < len(blocks):
                # sparse rows of counts, several texts (or one block of a long one) at a time
                size, end = 0, start
                while end < len(blocks) and (end == start or size + len(blocks[end][1]) <= BLOCK // 4):
                    size, end = size + len(blocks[end][1]), end + 1
                found = [features(text, letters, bits, orders) for _, text in blocks[start:end]]
                key = np.concatenate(found).astype(np.int64) + (np.repeat(np.arange(len(found)), list(map(len, found))) << 32)
                used, times = np.unique(key, return_counts=True)
                row = used >> 32
                first = np.flatnonzero(np.diff(row, prepend=-1))
                sums = np.add.reduceat(times[:, None] * matrix[used & 0xFFFFFFFF], first, axis=0)
                np.add.at(logs, [blocks[start + r][0] for r in row[first]], sums)
                start = end
            best = logs.argmax(axis=1)
            score_of = 1.0 / np.exp(logs - logs[np.arange(len(texts)), best][:, None]).sum(axis=1) if len(texts) else np.zeros(0)
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            for i in wanted:
                names[i], scores[i] = languages[best[i]], float(score_of[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(id_cols))] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*id_cols, "lang_pred", "score"])

    fields = [rows.schema[c] for c in id_cols]
    return rows.mapInArrow(score, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
