"""Quality classifier by compression.

Two zstandard dictionaries are built, one from text labelled good and one
from text labelled bad.  A text is compressed block by block with each of
them; the normalised difference of the two compressed sizes says which kind
of text it resembles, and the mean compressed share of its bytes tells
repetitive text.  A logistic fit on labelled rows that no dictionary has seen
turns both into a calibrated score; the rows of a label weigh as much as all
learnable rows of that label, so that the sample's size leaves the scores level.

Fitting reads a bounded sample of labelled rows (``SAMPLE`` per label, chosen
by a hash of the id; ``SAMPLE_BLOCKS`` blocks of each for the dictionaries).
Scoring reads every block of every text.  Only texts and labels are learnt
from; ids serve to choose the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

#: At most so many labelled rows per label are learnt from, half for the dictionaries and half for the calibration.
SAMPLE = 4000
#: At most so many blocks of a text, evenly spaced over it, go into a dictionary.
SAMPLE_BLOCKS = 8
#: Texts are compressed in blocks of so many bytes, so that a dictionary tells as much in a long text as in a short one.
BLOCK = 2048
DICTIONARY = 65536
LEVEL = 3
_SCALE = np.array([20.0, 10.0])


@dataclass(frozen=True)
class Model:
    """Dictionaries (None: no blocks of that label) and the logistic weights of (difference, share, 1)."""

    bad: bytes | None
    good: bytes | None
    weights: tuple[float, float, float]


def _blocks(raw: bytes) -> list[bytes]:
    return [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]


def _dictionary(samples: list[bytes]) -> bytes | None:
    """A trained dictionary; with too few samples for the trainer, their last bytes as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:] or None


def _compressor(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if held is not None:
        held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False)


def _figures(raw: bytes, bad: zstandard.ZstdCompressor, good: zstandard.ZstdCompressor) -> tuple[float, float]:
    """(bad - good) / (bad + good) of the compressed sizes, and their mean over the plain size; zeros for no bytes."""
    b = g = 0
    for block in _blocks(raw):
        b += len(bad.compress(block))
        g += len(good.compress(block))
    return ((b - g) / (b + g), (b + g) / (2 * len(raw))) if raw else (0.0, 0.0)


def _scored(df: DataFrame, model: Model, text_col: str, id_cols: tuple[str, ...]) -> DataFrame:
    """``id_cols`` with ``difference`` and ``share`` of each text."""
    held = df.sparkSession.sparkContext.broadcast((model.bad, model.good))
    rows = df.select(*id_cols, F.col(text_col).cast("binary").alias("__raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = map(_compressor, held.value)
        for batch in batches:
            found = np.array([_figures(raw.as_py() or b"", bad, good) for raw in batch.column(len(id_cols))]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found[:, 0]), pa.array(found[:, 1])],
                                             names=[*id_cols, "difference", "share"])

    fields = [rows.schema[c] for c in id_cols] + [T.StructField(c, T.DoubleType()) for c in ("difference", "share")]
    return rows.mapInArrow(run, T.StructType(fields))


def _sample_blocks(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = []
            for raw in batch.column(1):
                blocks = _blocks(raw.as_py())
                at = np.unique(np.linspace(0, len(blocks) - 1, SAMPLE_BLOCKS).astype(int)) if blocks else []
                picked.append([blocks[i] for i in at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(picked, pa.list_(pa.binary())), batch.column(2)],
                                             names=["label", "blocks", "place"])

    return rows.select("label", F.col("text").cast("binary"), "place").mapInArrow(
        run, "label int, blocks array<binary>, place bigint")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, weights: np.ndarray | None = None) -> tuple[float, float, float]:
    x = np.column_stack([x * _SCALE, np.ones(len(x))])
    w = np.zeros(3)
    k = np.ones(len(y)) if weights is None else weights * len(y) / weights.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (k * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(3),
                               x.T @ (k * (p - y)) / len(y) + ridge * w)
        w -= step
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on texts of ``docs`` whose id has label 0 or 1 in ``labels``.

    NULL labels and ids whose labels contradict each other are left out; of
    rows sharing an id one counts.  Without labelled texts every score is 0.5;
    with one label only, near it.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")) \
        .agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).alias("other")).where("label = other")
    known = staged(known.select("id", "label", F.xxhash64("id").alias("place")), "labels")
    # Rows that could be learnt from: labels whose text there is, however often its id comes.
    texts = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"))
    learnable = {r.label: r["count"] for r in known.join(texts, "id", "left_semi").groupBy("label").count().collect()}
    chosen = [known.where(F.col("label") == v).orderBy("place", "id").limit(SAMPLE) for v in (0, 1)]
    chosen = staged(chosen[0].unionByName(chosen[1]), "sample-ids")  # at most 2 * SAMPLE rows
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null") \
        .join(F.broadcast(chosen), "id").groupBy("id", "label", "place").agg(F.max("text").alias("text"))
    sample = staged(sample, "sample")
    first = F.pmod(F.xxhash64(F.lit("half"), F.col("id")), F.lit(2)) == 0
    blocks: dict[int, list[bytes]] = {0: [], 1: []}
    for row in sorted(_sample_blocks(sample.where(first)).collect(), key=lambda r: (r.place, r.label)):
        blocks[row.label] += map(bytes, row.blocks)
    model = Model(_dictionary(blocks[0]), _dictionary(blocks[1]), (0.0, 0.0, 0.0))
    if model.bad is None and model.good is None:
        return model
    rows = _scored(sample.where(~first), model, "text", ("label", "id")).toPandas().sort_values("id")
    if rows.empty:
        return model
    label = rows["label"].to_numpy()
    weight = np.array([learnable.get(v, 0) for v in (0, 1)]) / np.maximum(np.bincount(label, minlength=2), 1)
    return Model(model.bad, model.good, _logistic(rows[["difference", "share"]].to_numpy(), label.astype(float), weights=weight[label]))


def score(docs: DataFrame, model: Model, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_cols`` of every row with ``difference``, ``share`` and ``score`` (0 to 1, higher: good likelier).

    NULL and empty texts have difference and share 0, so their score is that
    of the intercept.
    """
    a, b, c = model.weights
    z = F.col("difference") * F.lit(a * _SCALE[0]) + F.col("share") * F.lit(b * _SCALE[1]) + F.lit(c)
    return _scored(docs, model, text_col, id_cols).withColumn("score", 1 / (1 + F.exp(-z)))
