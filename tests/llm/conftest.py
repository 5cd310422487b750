import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, shard string, slot string, score string, row string, key string, component string"
LONG = "a long story of many words that goes on and on " * 2000
ROWS = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (None, "a text whose row has no id at all", "en", "a", 3),
    (3, "the same words in the same order make a copy", "en", "b", 9), (4, "the same words in the same order make a copy", "en", "b", 9),
    (5, LONG, "en", "b", len(LONG)), (6, LONG, "en", None, len(LONG)), (7, " \t\n ", "fr", "c", 4), (8, "12345 !!! ###", None, "c", 13),
    (9, "ein kurzer Text auf deutsch", "de", "c", 27), (9, "ein kurzer Text auf deutsch", "de", "c", 27), (10, "\U0001f600 é ñ ß 漢字", "es", "d", 9),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows, extra columns with clashing names."""
    return spark.createDataFrame([(*r, *("x",) * 7) for r in ROWS], COLUMNS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("extra", F.lit(1))
