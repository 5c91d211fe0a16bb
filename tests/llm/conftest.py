import random

import pytest
from pyspark.sql import types as T

LONG = "palavra larga " * 40_000


@pytest.fixture(scope="session")
def documents_schema():
    return T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def awkward_rows():
    """NULLs in every column, empty, blank and very long texts, repeated rows and ties."""
    rng = random.Random(5)
    say = lambda n, of="alpha beta gamma delta epsilon zeta eta theta".split(): " ".join(rng.choice(of) for _ in range(n))
    base = say(60)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " end", "en", None, None),
        (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \t\n", "fr", "b", 3), (None, base, "en", "b", 1), (None, None, None, None, None),
        (7, LONG, "es", "a", len(LONG)), (8, "x", None, "c", 1), (9, "12 34 !!", "de", "c", 8), (10, say(12), "en", "a", 1), (11, say(13), "en", "a", 1),
        (12, "é à ü ñ 日本語 😀 " * 5, "fr", "c", 1), (13, say(200) + " " + base, "en", "a", 1), (-5, say(30) + " " + base + " " + say(5), "en", "a", 1)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, documents_schema):
    """The rows with extra columns whose names clash with those that operators add."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), documents_schema).repartition(3)
    for name in ("score", "size", "copy", "row", "ids", "fp", "class", "rep", "shard", "block", "_class", "rate", "named", "n_words", "kept"):
        df = df.withColumn(name, F.lit("extra"))
    return df


@pytest.fixture(scope="session")
def empty(spark, documents_schema):
    return spark.createDataFrame([], documents_schema)
