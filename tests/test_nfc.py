import unicodedata

from pyspark.sql import functions as F

from versicle.functions import text as T


def test_nfc_equals_unicodedata_without_python(spark):
    """Every assigned code point alone, after a letter and between marks; no Python in the plan."""
    points = [chr(c) for c in range(1, 0x20000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    rows = [("".join(f" {x} a{x} ẹ́{x}́" for x in points[i : i + 64]),) for i in range(0, len(points), 64)]
    texts = spark.createDataFrame([*rows, (None,), ("",), ("plain",), ("ਸ਼ 각",)], "t string")
    found = texts.select("t", T.nfc(F.col("t")).alias("n"))
    assert [r["n"] for r in found.collect()] == [None if r["t"] is None else unicodedata.normalize("NFC", r["t"]) for r in texts.collect()]
    assert "Python" not in _plan(texts.select(T.normalize(F.col("t"))))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
