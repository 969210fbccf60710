import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rank int, kept string, position double, row string, id string, sha int, digest string, bucket long, __bucket string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{i % 997}x{i % 13}" for i in range(30_000))
    texts = [None, "", "   \n\t", "one", "one", "two words", "Two  words", long, long + " end", "a" * 9000, "x\x1fy\x85z ñandú wide", "éá <|endoftext|> ", "1234 %% && ##\n%% && ##\n%% && ##", None]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", "s3"][i % 4], i, "x", 1, None, None, "r", "i", 1, "d", 5, "b") for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "s3", 3, "x", 1, None, None, None, None, None, None, None, None)] * 2
    rows += [(None, "lost", None, None, None, None, None, None, None, None, None, None, None, None, None)]
    # a source without words, and an id that repeats with other texts
    rows += [(90, None, "en", "s9", 1, None, None, None, None, None, None, None, None, None, None), (91, " \n", "en", "s9", 1, None, None, None, None, None, None, None, None, None, None), (92, "first", "en", "s2", 1, None, None, None, None, None, None, None, None, None, None), (92, "second text", "en", "s2", 1, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
