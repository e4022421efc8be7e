"""From raw documents to token ids: five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantrisk.llm import bpe, fertility, lines, mixing, simhash
from grantrisk.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave the bands of tokeniser fertility go."""
    return fertility.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds are cut out; ``n_chars`` follows the text."""
    kept = lines.drop_lines(docs)
    return kept.select(*[F.length("text").cast(kept.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
                         for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest id."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed by weights 5, 2, 1: a document comes as often as the mix takes it, or not at all."""
    return mixing.mix_sources(docs, weights=(5, 2, 1), share=1.0, max_epochs=3.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with their number and the digests of ids and decoded bytes."""
    ids = {"ids": (T.ArrayType(T.IntegerType()), lambda ids, raw: ids.astype(np.int32))}
    return bpe.encode_decode(docs.select("doc_id", "source", "text"), bpe.RANKS, ids | bpe.DIGESTS, keep_text=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: SQL expresses neither the token figures nor the fingerprints; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
