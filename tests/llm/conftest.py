from __future__ import annotations

import pytest

# Null texts and ids, empty and blank texts, ties, repeated rows and ids, and columns with clashing names.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank while seven bright stars shine above it all tonight", "en", "a", 5),
    (2, "The quick brown fox jumps over the lazy dog near the river bank while seven bright stars shine above it all tonight", "en", "a", 5),
    (2, "The quick brown fox jumps over the lazy dog near the river bank while seven bright stars shine above it all tonight", "en", "a", 5),
    (3, None, "en", None, None),
    (4, "", None, "b", 0),
    (5, " \t\n\x0b\x0c\r ", "en", "b", 7),
    (None, "a row without an id but with quite a few words in it so that it counts as text", "en", "a", 3),
    (6, "one two three", "en", "c", 13),
    (7, "wörter " * 9000, "de", "c", 1),
    (8, "é́ 日本語 😀 <|endoftext|> it's they're  x", "xx", "a", 1),
    (9, "same line that is long enough to compare with others\nsame line that is long enough to compare with others", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("size", "key", "h", "fp", "n", "th", "w", "shard", "slot", "kept", "component")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, "lazy dog near the river bank while seven bright"), (2, None), (3, "x"), (1, "lazy dog near the river bank while seven bright")], "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (1, 1, 0), (6, 0, None), (7, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
