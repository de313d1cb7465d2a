import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, kept_by string, component_id string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns named like results."""
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \t\n", "en", None, 3), (4, "word", "en", "a", 4), (5, "x " * 60_000, "en", "a", 120_000),
        (6, "é" * 5000, "fr", "b", 5000), (7, "same text here and there again", "en", "a", 30), (7, "same text here and there again", "en", "a", 30),
        (8, "same text here and there again", "de", "a", 30), (None, "a row without an id, long enough for a few chunks of text", "en", "a", 10), (9, "123 !!! ...", "en", "b", 11),
        (10, "中文 \U0001f642 mixed", None, None, None),
    ]
    return spark.createDataFrame([(*r, "s", "p", "k", "c") for r in rows], DOCS)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
