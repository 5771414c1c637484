import pytest

from pyspark.sql import functions as F

EDGES = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from here " * 6),
    (2, "the quick brown fox jumps over the lazy dog and runs away from here " * 6),
    (3, ""), (4, None), (5, " \n\t "), (6, "a"), (7, "é" * 30 + " ünï " + "ß" * 90),
    (8, "word " * 40_000), (9, "x" * 60_000), (None, "a text without an id"), (None, None), (6, "a"), (6, "another text of the same id"), (10, "you are an idiot and a moron, total scum"), (11, "<|endoftext|> it's 3 o'clock\r\n\x1c"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, copies, repeated rows and ids, and columns named like internal ones."""
    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    n = F.length("text").cast("long")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), n.alias("n_chars"), *(F.lit(i).alias(c) for i, c in enumerate(("fp", "part", "at", "size", "key", "score", "spans", "root", "block", "ids", "predicted"))))


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
