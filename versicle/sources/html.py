"""Pages of HTML to line records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# Words and signs of headers in the source script.
SECTION_WORD = "ਰਾਗ"
MAHALLA = "(?:ਮਹਲਾ|ਮਃ|ਮਹਲੁ)\\s*([੦-੯]+)"
AUTHORS = {1: "M1", 2: "M2", 3: "M3", 4: "M4", 5: "M5", 9: "M9"}

#: Text of a cell: its tags are spaces, the common entities are decoded.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def scan_directory(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, pattern: str = "ang_*.html") -> DataFrame:
    """(page, html, path) of the files ``ang_<n>.html`` under a folder, in a page range."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("value").alias("html"), F.input_file_name().alias("path"))
    found = files.withColumn("page", F.regexp_extract("path", "ang_(\\d+)\\.html$", 1).try_cast("int")).filter("page is not null")
    if first is not None:
        found = found.filter(F.col("page") >= first)
    return found.filter(F.col("page") <= last) if last is not None else found


def strip_tags(html: Column, with_: str = " ") -> Column:
    text = F.regexp_replace(html, "(?s)<[^>]*>", with_)
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return T.collapse(text)


def cells(html: Column, tag: str = "td", script: bool = True) -> Column:
    """Line texts of a page: of the ``font`` elements of the script's face; without any, of the cells
    of ``tag`` with over two characters, over 0.3 of them in the script."""
    fonts = F.transform(F.regexp_extract_all(html, F.lit("(?is)<font[^>]*face\\s*=\\s*[\"']?anmol[^>]*>(.*?)</font>"), 1), lambda x: strip_tags(x))
    fonts = F.filter(fonts, lambda t: (t != "") & (T.has_script(t) if script else F.lit(True)))
    # innermost cells only: one with another cell inside is not a line
    others = F.transform(F.regexp_extract_all(html, F.lit(f"(?is)<{tag}(?:\\s[^>]*)?>((?:(?!<{tag}[\\s>]).)*?)</{tag}>"), 1), lambda x: strip_tags(x))
    others = F.filter(others, lambda t: (F.length(t) > 2) & ((T.script_ratio(t) > 0.3) if script else F.lit(True)))
    return F.when(F.size(fonts) > 0, fonts).otherwise(others)


def parse_lines(pages: DataFrame, page_col: str = "page", html_col: str = "html", tag: str = "td", script: bool = True) -> DataFrame:
    """(page, line_number, raw) of every line of every page; a page without lines gives one row of nulls and error PARSE_SELECTOR_FAIL."""
    found = pages.select(F.col(page_col).alias("page"), F.posexplode_outer(cells(F.col(html_col), tag, script)).alias("i", "raw"))
    return found.select("page", (F.col("i") + 1).alias("line_number"), "raw", F.when(F.col("raw").isNull(), "PARSE_SELECTOR_FAIL").alias("error"))


def structure(lines: DataFrame) -> DataFrame:
    """Section and author carried forward within the page, running group number, refrain and stanza marks."""
    section = F.when(F.col("raw").contains(SECTION_WORD), F.trim("raw"))
    number = T.numeral(F.regexp_extract("raw", MAHALLA, 1))
    names = F.create_map(*[F.lit(x) for kv in AUTHORS.items() for x in kv])
    author = F.when(number.isNotNull(), F.coalesce(F.try_element_at(names, number), F.concat(F.lit("M"), number.cast("string"))))
    w = Window.partitionBy("page").orderBy("line_number")
    found = lines.filter("raw is not null").select("*", section.alias("__s"), author.alias("__a"))
    found = found.select("*", F.last("__s", ignorenulls=True).over(w).alias("section"), F.last("__a", ignorenulls=True).over(w).alias("author"), F.count("__a").over(w).alias("__n"))
    group = F.when(F.col("__n") > 0, F.concat(F.coalesce("section", F.lit("UNK")), F.lit("-"), F.format_string("%03d", "__n")))
    return found.select("page", "line_number", "raw", "section", "author", group.alias("group_id"), F.col("raw").rlike(f"(?U)\\b{T.REFRAIN}\\b").alias("rahao"), T.numeral(F.col("raw")).alias("pauri"))


def canonical(lines: DataFrame, policy: T.Normalization = T.Normalization(), url: str = "https://example.org/page/{}") -> DataFrame:
    """Line records with ids, normalised text, tokens and their spans."""
    line_id = F.concat(F.col("page").cast("string"), F.lit(":"), F.format_string("%02d", "line_number"))
    found = lines.withColumns({"line_id": line_id, "text": T.normalize(F.col("raw"), policy)})
    markers, _ = T.structural_markers(F.col("text"))
    found = found.withColumns({"line_uid": T.line_uid(F.col("page"), F.col("line_id"), F.col("text")), "tokens": T.tokens(F.col("text")), "structural_markers": markers, "schema_version": F.lit("1.0.0"), "source_url": F.concat(F.lit(url.split("{}")[0]), F.col("page").cast("string"))})
    return found.withColumn("token_spans", T.token_spans(F.col("text"), F.col("tokens")))


def paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, n, text) of the p elements, tags and entities resolved."""
    each = F.filter(F.transform(F.regexp_extract_all(F.col(html_col), F.lit("(?is)<p(?:\\s[^>]*)?>(.*?)(?=</p>|<p[\\s>]|</article>|$)"), 1), lambda x: strip_tags(x)), lambda t: t != "")
    return pages.select(id_col, F.posexplode(each).alias("n", "text"))


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", tags: tuple[str, ...] = ("td", "div", "span", "p")) -> DataFrame:
    """(page_id, tag, n) counts of opening tags, for looking at a page's structure."""
    each = F.array(*(F.struct(F.lit(t).alias("tag"), F.size(F.regexp_extract_all(F.col(html_col), F.lit(f"(?i)<({t})[\\s>]"), 1)).alias("n")) for t in tags))
    return pages.select(id_col, F.explode(each).alias("e")).select(id_col, "e.tag", "e.n")
