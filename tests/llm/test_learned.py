"""Language identification and the quality classifier: held-out accuracy and odd input."""

import pytest
import zstandard
from pyspark.sql import functions as F

from grantrisk.llm import langid, quality
from grantrisk.llm.queries import op2_quality, op6_language

SF = "/root/testdata/sf0.1"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op6_language(spark, SF).join(docs, "doc_id").where("held_out and lang_pred <> 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    assert op6_language(spark, SF).count() == docs.count()


def test_language_odd_documents(odd_docs, no_docs):
    model = langid.fit(odd_docs)
    assert model.languages == ("de", "en")
    got = langid.predict(odd_docs, model)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert [r.lang_pred for r in rows if r.doc_id in (3, 4, 5)] == ["und"] * 3
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2)} == {"en"}
    nothing = langid.fit(no_docs)
    assert nothing.languages == ()
    assert {(r.lang_pred, r.score) for r in langid.predict(odd_docs, nothing).collect()} == {("und", 0.0)}
    assert langid.predict(no_docs, model).count() == 0


def test_language_blocks_and_letters():
    letters = langid.letter_table()
    assert len(langid.features("abc", letters, 12, (1, 2, 3))) == 5 + 4 + 3
    assert list(langid.features("A1b", letters, 12, (2,))) == list(langid.features("a b", letters, 12, (2,)))


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = op2_quality(spark, SF).join(labels, "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double")),
                F.avg(F.when(F.col("quality") == 1, F.col("predicted"))), F.avg(F.when(F.col("quality") == 0, 1 - F.col("predicted")))).first()
    assert r[0] > 0.95 and r[1] > 0.98 and r[2] > 0.8


def test_quality_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, 0), (2, None), (None, 1), (7, 0), (7, 1)], "doc_id long, quality int")
    for model in (quality.fit(odd_docs, labels), quality.fit(odd_docs, labels.limit(0)), quality.fit(no_docs, labels)):
        rows = quality.score(odd_docs, model).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
        assert quality.score(no_docs, model).count() == 0


def test_quality_figures_read_every_block():
    plain = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
    raw = bytes(range(256)) * 100
    difference, share = quality._figures(raw, plain, plain)
    size = sum(len(plain.compress(raw[i:i + quality.BLOCK])) for i in range(0, len(raw), quality.BLOCK))
    assert difference == 0 and share == pytest.approx(size / len(raw))


def test_calibration_is_a_probability():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(scale=0.1, size=(4000, 2))
    p = 1 / (1 + np.exp(-(x @ np.array([20.0, 0.0]) * 1.0 + 0.5)))
    w = quality._logistic(x, (rng.random(4000) < p).astype(float))
    assert w[0] == pytest.approx(1.0, abs=0.2) and w[2] == pytest.approx(0.5, abs=0.2)


def test_a_smaller_sample_leaves_the_score_level(spark, monkeypatch):
    import random

    import numpy as np

    rng = random.Random(0)
    good, odd = (["".join(rng.choices(a, k=rng.randrange(3, 8))) for _ in range(400)] for a in ("abcdefgh", "fghijklm"))
    rows, labels = [], []
    for i in range(2400):  # ten good texts to a bad one, both of mixed words
        bad = i % 11 == 0
        share = rng.betavariate(2, 3) if bad else rng.betavariate(3, 2)
        rows.append((i, " ".join(rng.choice(good if rng.random() < share else odd) for _ in range(60))))
        labels.append((i, 0 if bad else 1))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")

    def level():
        return np.mean([r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()])

    whole = level()
    monkeypatch.setattr(quality, "SAMPLE", 200)
    assert abs(whole - 10 / 11) < 0.05 and abs(level() - whole) < 0.05
