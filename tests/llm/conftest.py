import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, `row` string, size string, `key` string, "
          "id string, label string, __text string, kept string, measures string, shard string, fp string, copies string")
EXTRA = tuple("x" for _ in range(11))
LONG = "Wort und zahl 12 " * 20000 + "\n" + "z" * 70000


def rows_of(*docs):
    """(doc_id, text, lang, source) -> full rows with clashing extra columns."""
    return [(i, t, lang, source, None if t is None else len(t), *EXTRA) for i, t, lang, source in docs]


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda *docs: spark.createDataFrame(rows_of(*docs), SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """NULLs in every column, empty, blank and very long texts, repeated rows."""
    return docs_of(
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "b"),
        (3, None, "en", "a"), (4, "", None, "a"), (5, " \n\t\n ", "de", None), (6, LONG, "de", "b"),
        (None, "ein text ohne nummer der trotzdem gelesen wird und zwar ganz", "de", "a"),
        (None, None, None, None), (7, "naïve ☃ 漢字 \U0001f600 zero​width 123 ### $$$", None, None))


@pytest.fixture(scope="session")
def no_docs(docs_of, odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
