from __future__ import annotations

import pytest

#: Rows with every hard case: nulls, empty and long texts, ties, repeats.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (3, "The quick brown fox jumps over the lazy dog near the old river bank tonight"),
    (4, None),
    (5, ""),
    (6, "uno"),
    (None, "Sin identificador pero con texto"),
    (7, "Ünïcode – ñandú 日本語 😀"),
    (8, "long word " * 30_000),
    (9, "   \n\t "),
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA)


@pytest.fixture
def clashing(spark):
    """The same rows with columns named like internal and result columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(TEXTS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("id", "hash", "cls", "keep_id", "print", "n", "bucket", "score", "fingerprint", "rule", "source", "label", "u", "v", "ids")})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
