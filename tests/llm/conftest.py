import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
PROSE = " ".join(f"word{i * 7919 % 997} and{i % 13}" for i in range(60))


def odd_rows():
    """Nulls in every column, empty and blank texts, one very long text, ties, repeated rows."""
    other = PROSE.replace("word7", "changed")
    rows = [
        (1, PROSE, "en", "a", 5), (2, PROSE, "en", "a", 5), (2, PROSE, "en", "a", 5), (3, other, "de", None, None), (4, None, None, "b", None), (5, "", "en", "b", 0),
        (6, " \t\n ", "fr", "", 4), (None, PROSE, "en", "a", 1), (None, None, None, None, None), (7, "one", "en", "a", 3), (8, "ONE", "en", "z", 3), (9, "two words", None, "é", 9),
        (10, "\n".join([PROSE] * 200), "en", "a", 1), (11, "password=abcdefghijkl1234 é token: x", "en", "a", 1), (12, "!!! 123", "en", "a", 7), (13, "😀 naïve 𝒳 ▁mark", "fr", "c", 1),
    ]
    return rows


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], SCHEMA)
