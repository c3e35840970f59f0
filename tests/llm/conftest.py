import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()), T.StructField("id", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n", T.LongType())])
PASSAGE = " ".join(f"word{i} größe" for i in range(60))
LONG = " ".join(f"tok{i % 4001} x{i % 17}" for i in range(30_000))


def rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, clashing names."""
    texts = [(1, PASSAGE), (2, "start " + PASSAGE + " end"), (2, "start " + PASSAGE + " end"), (3, None), (4, ""), (5, " \t\n "), (None, PASSAGE), (None, None), (6, LONG), (7, "a b"), (8, "A  b"), (9, "aaaa " * 200), (10, "😀 ünïcode " * 30), (11, "one\0two " * 40)]
    return [(i, t, None, ("s1", "s2", None)[k % 3], None, "r", None, "k", None) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
