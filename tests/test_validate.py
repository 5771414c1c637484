import time

from pyspark.sql import functions as F

from versicle.operators import corpus

LINE = "line_uid string, text string, tokens array<string>, token_spans array<struct<start:int,end:int>>, schema_version string"


def test_span_checks(spark):
    rows = [("a", "ab cd", ["ab", "cd"], [(0, 2), (3, 5)]), ("b", "ab cd", ["ab", "cd"], [(0, 2), (0, 2)]), ("c", "ab", ["ab"], [(0, 3)]), ("d", "ab", ["ab"], [(-1, -1)]), ("e", "ab", ["ab"], []), ("f", None, [], []), ("g", None, ["a"], [(0, 1)]), ("h", "é a", ["é"], [(0, 1)]), ("i", "ab", ["ab"], None)]
    found = corpus.validate(spark.createDataFrame([(*r, "1.0.0") for r in rows], LINE), F.col("text"))
    got = {r.check: r.failures for r in found.collect()}
    assert (got["token_span_counts"], got["token_spans_valid"], got["token_spans_match"]) == (2, 4, 3) and got["expected_characters"] == 3


def test_span_checks_are_linear_in_a_line(spark):
    n = 100_000
    long = spark.range(1).select(F.lit("a").alias("line_uid"), F.array_join(F.array_repeat(F.lit("word"), n), " ").alias("text"), F.array_repeat(F.lit("word"), n).alias("tokens"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 5).cast("int").alias("start"), (i * 5 + 4).cast("int").alias("end"))).alias("token_spans"), F.lit("1.0.0").alias("schema_version"))
    began = time.time()
    assert {r.check for r in corpus.validate(long, F.col("text")).filter("failures > 0").collect()} == {"token_count_sane"}
    assert time.time() - began < 15
