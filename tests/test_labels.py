import duckdb
import pytest

from versicle import plans


@pytest.fixture(scope="module")
def late_pages(spark, tmp_path_factory):
    """Documents on both sides of pages 951, 1001 and 10001."""
    path = str(tmp_path_factory.mktemp("late"))
    ids = (0, 9_489, 9_500, 9_999, 10_000, 10_499, 10_500, 100_000, 100_500)
    rows = [(i, "the one\nof the two", "en", "s") for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["chunk_totals", "page_bucket"])
def test_labels_equal_sql_beyond_page_999(spark, late_pages, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{late_pages}/documents.parquet/*.parquet'")
    want = sorted(con.execute(plans.oracle_sql()[name]).fetchall())
    assert sorted(map(tuple, plans.queries()[name](spark, late_pages).collect())) == want
    assert any("chunk_100-105" in r for r in want)


@pytest.mark.parametrize("name", ["entity_by_section", "section_stats", "tag_grouping_sets"])
def test_sections_equal_sql_past_their_end(spark, tmp_path, name):
    """Pages in every section, past the last one, and a document without a source."""
    rows = [(i, "the one\nof the two is", "en", None if i == 500 else "s") for i in (0, 310, 700, 500, 960, 199_999, 200_050, 200_100, 9_000_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(plans.oracle_sql()[name])
    columns, want = [c[0] for c in found.description], found.fetchall()
    got = plans.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
