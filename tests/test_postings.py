from pyspark.sql import functions as F

from versicle.operators import search


def test_postings_shuffle_lines_and_hold_each_once(spark, monkeypatch):
    """Against a plain count: empty and null terms, repeated words and lines, nulls, parts cut into several batches."""
    monkeypatch.setattr(search, "BATCH", 3)
    rows = [(p, n, f"u{p}:{n}", t) for p, n, t in [(1, 0, ["b", "a", "b"]), (1, 1, []), (2, 0, None), (2, 1, ["a", None]), (51, 0, ["a"]), (3, 0, ["c", "a"]), (None, 0, ["a"]), (50, 2, ["", "a"])]]
    lines = spark.createDataFrame([*rows, rows[0], rows[3]], "page int, line_number int, line_uid string, tokens array<string>").repartition(3)
    got = search.postings(lines, "tokens")
    want: dict = {}
    for page, number, uid, tokens in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        for term in dict.fromkeys(tokens or []):
            want.setdefault((term, None if page is None else (page - 1) // 50 * 50 + 1), []).append(uid)
    assert {(r.term, r.part): list(r.docs) for r in got.collect()} == want
    assert got.filter(F.col("n_docs") != F.size("docs")).count() == 0 and got.count() == len(want)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
