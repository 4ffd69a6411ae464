"""Small document tables with the awkward cases that every operator has to stand."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "The quick brown fox jumps over the lazy dog near the river bank. " * 4000

#: Nulls in every column, empty and very long texts, ties and equal rows.
ROWS = [
    (1, "Hello World, it's a fine day", "en", "a", 28),
    (2, "hello world, it's a fine day", "en", "a", 28),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, LONG, "en", "b", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (None, "Größe ΣΑΣ 中文 🙂 naïve x\x1c\x85 y", "de", "c", 30),
    (None, None, None, None, None),
    (7, " \t\n ", "en", "c", 4),
    (8, "x" * 5000, "en", "c", 5000),
    (9, "<|endoftext|> a <|endoftext|><|startoftext|>b <p>", "en", "c", 40),
    (10, "don't we'll they've I'd 12345 ... 1e-9 \r\n\r\n  two  spaces   ", "en", "c", 50),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark, awkward):
    """More columns, named as the operators' own."""
    from pyspark.sql import functions as F

    names = ("digest", "_gone", "keep_id", "group_size", "fp", "n", "y", "root", "_salt", "_hot", "a", "b", "anchor", "ids", "score", "body", "turns")
    return awkward.withColumns({c: F.lit(1) for c in names})
