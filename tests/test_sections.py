from versicle.operators import density
from versicle.plans import analysis, base, text


def test_late_pages_have_a_section(spark, tmp_path):
    """Documents past page 20010 are in REST, and the empty section stays empty."""
    docs = [(1, "the one", "en", "s"), (200_050, "the two", "en", "s"), (9_000_000, "the three", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.section, r.dim): r.lines for r in text.section_stats(spark, str(tmp_path)).collect()}
    assert {s for s, _ in got} == {i for i, _, _ in base.SECTIONS}
    assert {n for (s, _), n in got.items() if s == "REST"} == {2} and {n for (s, _), n in got.items() if s == "NONE"} == {0}
    assert {r["section"] for r in analysis._tags(spark, str(tmp_path)).collect()} == {"S1", "REST"}
    counts = text.entity_by_section(spark, str(tmp_path)).collect()
    assert sum(r["count"] for r in counts if r["section"] == "REST") == 2 * sum(r["count"] for r in counts if r["section"] == "S1") > 0


def test_no_endless_section(spark):
    sections = spark.createDataFrame([("S", "S", 1, 3, 0)], density.SECTION)
    rows = spark.createDataFrame([(1,), (4,)], "page int")
    assert [tuple(r) for r in density.in_section(rows, sections).select("page", "section").collect()] == [(1, "S")]
