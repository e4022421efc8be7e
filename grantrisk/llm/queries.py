"""Registered queries of the subpackage: thin callers of its operators."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, codes, fertility, langid, lines, mixing, quality, sharding, simhash, sketches, urls, vectors
from .common import in_fold, staged, table

URL_RULES = (urls.Rule("allow", "org/"), urls.Rule("block", "example.org/es/"), urls.Rule("block", "example.org/en/1"),
             urls.Rule("allow", "com/fr/"), urls.Rule("block", "com/de/"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes (tokens and rows balanced as well)."""
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality score of every document, learnt from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~in_fold("doc_id", 3, 1))
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more within a label, and their groups, for every embedding."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and dropped, and a digest of what stays, of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.drop_lines(docs, counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    return bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.RANKS, bpe.DIGESTS, keep_text=False)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~in_fold("doc_id", 5, 0)))
    return langid.predict(docs, model).select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of four-word shingles and near-duplicate group (at most 4 bits apart) of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page: the five rules, else its host's reputation from the labelled documents that its pages show."""
    pages = table(spark, sf_dir, "pages")
    outcomes = urls.outcomes_of(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    judged = urls.filter_urls(pages.select("page_id", "url"), outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document: base rules, then bands of tokeniser fertility per language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    frame = staged(fertility.measured(docs, into="m").drop("text"), "fertility")
    counts = [f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return fertility.judged(frame, "m").select(
        "doc_id", *counts, F.col("m_failed").alias("base_failed"), F.col("m_kept").alias("kept"),
        "m.chars_per_token", "m.byte_share", "m.token_entropy")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of weights 5, 2, 1 over the sources takes of every document."""
    items = staged(mixing.items_of(table(spark, sf_dir, "documents")), "mix-items")
    mixed = mixing.apply_mix(items, mixing.plan_mix(items, (5, 2, 1), 1.0, 3.0))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph sketches of every document and of its edited text, and their likeness to that and to the next document."""
    return sketches.edit_figures(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two vocabularies aligned by bytes: counts, links with their corpus-wide counts, digest of the groups."""
    return align.alignment_figures(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every embedding with 16 codebooks of 64 entries, their errors, summed by label too, and the codebooks' digest."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = codes.fit(vectors, parts=16, entries=64, rounds=2)
    coded = codes.with_group_error(staged(codes.encode(vectors, books), "codes"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_embeddings": op3_embeddings,
    "op4_line_dedup": op4_line_dedup,
    "op5_bpe": op5_bpe,
    "op6_language": op6_language,
    "op7_simhash": op7_simhash,
    "op8_url_filter": op8_url_filter,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_fingerprints": op11_fingerprints,
    "op12_alignment": op12_alignment,
    "op13_codes": op13_codes,
    "pipeline": corpus_pipeline.run,
}
