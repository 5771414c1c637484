import duckdb
from pyspark.sql import functions as F

from versicle.llm import urls


def test_rare_words_count_in_large_tables(spark):
    """More distinct title words than any cap of 50,000: those that occur once still hold a host together."""
    letters = F.translate(F.lpad(F.conv(F.col("id").cast("string"), 10, 8), 6, "0"), "01234567", "qzjkvwyf")
    many = spark.range(60_000).select((F.col("id") + 100).alias("page_id"), F.lit("http://example.net/").alias("url"), F.concat(F.lit("<title>"), letters, F.lit(" "), letters, F.lit("</title>")).alias("html"))
    names = ["winchester", "darwin", "godwin", "betsy", "alphabets"]
    rare = spark.createDataFrame([(i, f"http://{w}.example.net/", f"<title>{w}</title>") for i, w in enumerate(names)], "page_id long, url string, html string")
    got = {r.page_id: (r.words.split()[0], r.verdict) for r in urls.judge(many.unionByName(rare)).filter("page_id < 100").collect()}
    assert got == {i: (w, "allow") for i, w in enumerate(names)}


#: Names in neither training list, to be told apart run together, as a host has them.
BLOCK = (
    "casino royal win", "bonus slots", "poker jackpot", "free bets now", "lucky lottery", "gambling tips", "live porn", "sex tube", "adult singles", "nude cams", "escorts chat", "discount viagra", "online pharmacy meds", "cheap pills", "diet miracle",
    "xanax pharmacy", "quick loans", "bitcoin profit", "money doubler", "spam blast", "ads seller", "banner traffic", "cracks download", "replica shoes", "fake watches", "followers shop", "spam farm", "ads track",
)
ALLOW = (
    "university library", "science news", "garden recipe", "history journal", "music festival", "village school", "weather data", "river museum", "health research", "poetry club", "film theatre", "football museum", "bird garden", "children radio",
    "open physics", "python notes", "mountain trails", "national theatre", "city council", "ocean research", "train timetable", "bread market", "town library", "college chess", "folk stories", "medical school", "language lab", "fire museum",
)


def test_names_of_neither_list(spark):
    """Recall and precision of blocking on names that share no whole name with the training lists."""
    assert not {*BLOCK, *ALLOW} & {*urls.BLOCK_NAMES, *urls.ALLOW_NAMES}
    hosts = {name: f"http://www.{name.replace(' ', '')}.example.net/en/" for name in (*BLOCK, *ALLOW)}
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(hosts.values())], "page_id long, url string, html string")
    got = {name: r.verdict for name, r in zip(hosts, urls.judge(df).orderBy("page_id").collect(), strict=True)}
    caught, wrong = [n for n in BLOCK if got[n] == "block"], [n for n in ALLOW if got[n] == "block"]
    assert len(caught) >= 0.9 * len(BLOCK), set(BLOCK) - set(caught)
    assert len(caught) >= 0.9 * (len(caught) + len(wrong)), wrong


def test_no_host_of_the_table_is_a_training_name(spark):
    hosts = {h for (h,) in duckdb.sql("SELECT DISTINCT regexp_extract(url, '://(?:www\\.|m\\.|blog\\.)?([^./]*)', 1) FROM '/root/testdata/sf0.1/pages.parquet'").fetchall()}
    assert not {h.replace("-", " ") for h in hosts} & {*urls.BLOCK_NAMES, *urls.ALLOW_NAMES}


def test_host_path_and_rule_equal_sql(spark):
    """All but the verdict is plain SQL; repeated rows and very long URLs among them."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    extra = [(90_000, None, None), (90_001, "http://A.B.example.org/es/" + "x" * 30_000, None), (90_002, "nothing", ""), (90_003, "https://COM/fr/?q#f", ""), (90_003, "https://COM/fr/?q#f", ""), (90_004, "http://example.org/en/1", None)]
    frame = pages.unionByName(spark.createDataFrame(extra, "page_id long, url string, html string"))
    given = frame.select("page_id", "url").toPandas()  # noqa: F841 (the SQL reads it)
    sql = """WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM given),
h AS (SELECT page_id, lower(regexp_extract(rest, '(?s)^([^/?#]*)', 1)) AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rh, rp) AS (VALUES ('org', '/'), ('example.org', '/es/'), ('example.org', '/en/1'), ('com', '/fr/'), ('com', '/de/'))
SELECT page_id, host, path, (SELECT rh || rp FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1) AS rule FROM h"""
    want = sorted(duckdb.sql(sql).fetchall(), key=str)
    got = sorted((tuple(r) for r in urls.judge(frame).select("page_id", "host", "path", "rule").collect()), key=str)
    assert got == want
    assert urls.unigrams(frame.limit(0)).count() == 0 and urls.unigrams(frame.filter("page_id >= 90000")).count() == 0
