import os

import pytest
from pyspark.sql import functions as F

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, other columns."""
    long_text = "Der Hund und die Katze. " * 4000
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, "b", 4),
        (4, "The cat sat on the mat.\nThe cat sat on the mat.", "en", None, 48),
        (4, "The cat sat on the mat.\nThe cat sat on the mat.", "en", None, 48),
        (None, "Ohne Nummer geht es auch, sagt der Mann.", "de", "b", 40),
        (None, None, None, None, None),
        (5, long_text, "de", "c", len(long_text)),
        (6, "12345 !!! 678", "en", "c", 13),
    ]
    plain = spark.createDataFrame(rows, SCHEMA)
    clashing = ("score", "predicted", "fingerprint", "weight", "rejected", "probability", "posterior", "word", "spans", "key_", "h1_")
    return plain.select("*", *[F.lit(name).alias(name) for name in clashing])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
