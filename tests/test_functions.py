import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versicle.functions import text as T


def column(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_normalize_policies(spark):
    texts = ["  ਸਤਿ   ਨਾਮੁ ॥", "ਹਰਿ ਹਰਿ; ਨਾਨਕ, ॥", "ਕਾਂ", "ਜ਼", "a‌b", None, "", "ਮਃ ੧।੨ ।", "é"]
    got = column(spark, texts, T.normalize(F.col("t")))
    assert [g[0] for g in got] == ["ਸਤਿ ਨਾਮੁ", "ਹਰਿ ਹਰਿ ਨਾਨਕ", "ਕਾੰ", unicodedata.normalize("NFC", "ਜ਼"), "ab", None, "", "ਮਃ ੧।੨", "é"]
    kept = column(spark, ["ਕੰ ਜ਼ ੜ।x"], T.normalize(F.col("t"), T.Normalization("strip", "bindi", "preserve_separate")))
    assert kept == [("ਕਂ ਜ ਡ । x",)]
    with pytest.raises(ValueError):
        T.Normalization(nukta="other")
    assert len(T.Normalization().steps()) == 7


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ਸਤਿਨਾਮੁਂੰ।॥;, ab਼੧", max_size=60), min_size=20, max_size=40))
def test_normalize_is_idempotent(spark, texts):
    once = T.normalize(F.col("t"))
    assert all(a == b for a, b in column(spark, texts, once, T.normalize(once)))


def test_tokens_and_markers(spark):
    texts = ["ਸੋਚੈ ਸੋਚਿ ਨ ਹੋਵਈ ਜੇ ਸੋਚੀ ਲਖ ਵਾਰ ॥੧॥", "ਹਰਿ ਰਹਾਉ ॥ ੧ ੨", "(a) --b! a", "", "॥ ੧ ॥"]
    got = column(spark, texts, T.tokens(F.col("t")), T.structural_markers(F.col("t"))[0], T.token_spans(F.col("t"), T.tokens(F.col("t"))))
    assert got[0][0] == "ਸੋਚੈ ਸੋਚਿ ਨ ਹੋਵਈ ਜੇ ਸੋਚੀ ਲਖ ਵਾਰ".split()
    assert got[1][1][:2] == ["ਰਹਾਉ", "॥"] and "੨" in got[1][0]  # the second numeral stays a token
    assert got[2][0] == ["a", "b", "a"] and [tuple(s) for s in got[2][2]] == [(1, 2), (6, 7), (9, 10)]
    assert got[3][0] == [] and got[4][0] == []
    for text, (tokens, _, spans) in zip(texts, got):
        assert all(text[s.start : s.end] == t for t, s in zip(tokens, spans))


def test_missing_token_has_no_span(spark):
    df = spark.createDataFrame([("ab cd", ["cd", "xx", "ab"])], "t string, k array<string>")
    row = df.select(T.token_spans(F.col("t"), F.col("k"), restart=False).alias("s"), T.token_spans(F.col("t"), F.col("k")).alias("r")).first()
    assert [tuple(x) for x in row.s] == [(3, 5), (-1, -1), (-1, -1)] and [tuple(x) for x in row.r] == [(3, 5), (-1, -1), (0, 2)]


def test_labels_rates_and_sigmoid(spark):
    df = spark.createDataFrame([(0,), (1,), (100,), (101,), (-3,)], "p int")
    assert [r[0] for r in df.select(T.bucket(F.col("p"))).collect()] == ["unknown", "1-100", "1-100", "101-200", "unknown"]
    assert df.select(T.chunk(F.lit(51))).first()[0] == "chunk_051-100"
    row = df.select(T.density(F.lit(1), F.lit(3)), T.density(F.lit(1), F.lit(0)), T.rate(F.lit(3), F.lit(7), 1000), T.sigmoid(F.lit(1.5), 2, 1.5), T.sigmoid(F.lit(-1e6), 2, 0), T.sigmoid(F.lit(1e6), 2, 0), T.sigmoid(F.lit(2.0), 2, 1.5)).first()
    assert tuple(row)[:6] == (0.333333, 0.0, 428.5714, 0.5, 0.0, 1.0) and math.isclose(row[6], 1 / (1 + math.exp(-1)))


def test_script_and_numerals(spark):
    got = column(spark, ["ਕਖ੧੨ x", "abc", ""], T.has_script(F.col("t")), F.round(T.script_ratio(F.col("t")), 4), T.numeral(F.col("t")), T.unexpected_characters(F.col("t")))
    assert got == [(True, 0.6667, 12, []), (False, 0.0, None, []), (False, 0.0, None, [])]
    assert column(spark, ["é☃a"], T.unexpected_characters(F.col("t"))) == [(["é", "☃"],)]
    long = "੧" * 12
    assert column(spark, [long, "੧" * 40], T.numeral(F.col("t"))) == [(111_111_111_111,), (None,)]
