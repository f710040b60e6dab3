import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Nulls in every column, empty and blank texts, repeated rows, odd characters.
ODD = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, "  \n\t ", "en", None, 5),
    (None, "a null id", "en", "a", 9),
    (4, "twice the same row here, token = abcdef12345", "en", "b", 44),
    (4, "twice the same row here, token = abcdef12345", "en", "b", 44),
    (5, "ünï © 中文字 \U0001f600 <|endoftext|> x   y", "xx", "c", 30),
    (6, "1234 !!! ###", "en", "c", 12),
    (7, "word " * 3000, "en", "c", 15000),
    (8, "İİ Password: hunter2222 AKIA" + "A" * 16, "en", "c", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def schema():
    return SCHEMA
