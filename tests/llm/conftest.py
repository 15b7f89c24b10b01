import duckdb
import pytest


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def duck():
    return duckdb.connect()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "123 456 !!", "de"), (5, "same words here in order", "en"), (5, "same words here in order", "en"),
        (6, "same words here in order", None), (None, "no identity at all", "en"), (7, "x" * 200_000, "en"), (8, "long text of words " * 20_000, "en"), (9, "Ünïcödé lines\x85here \U0001f600", "fr"),
    ]
    table = spark.createDataFrame([(i, t, lang, "s", 0, True, 0.5, "k") for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, score double, key string")
    return table


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
