"""Densities by page, section and sliding window of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECTION = "id string, romanized string, page_start int, page_end int, ord int"


def exact_mean(total, n):
    """Mean of densities from their sum in whole millionths, to the nearest one: no order of rows changes it."""
    return F.floor(total / n + 0.5) / 1e6


def millionths(density="density"):
    """Sum of six-place densities as a whole number."""
    return F.sum(F.round(F.col(density) * 1e6).cast("long"))


def page_map(sections: DataFrame) -> DataFrame:
    """(page, section): the intervals spelled out, the first in order where several hold a page; as small as the page range."""
    each = sections.select(F.col("id").alias("section"), "ord", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return each.groupBy("page").agg(F.min_by("section", "ord").alias("section"))


def in_section(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """``rows`` with the ``section`` of their page, without those in none. One section may have a null
    page_end: it holds the pages from its start on that no other section holds."""
    endless = sections.filter("page_end IS NULL").orderBy("ord").limit(1).select(F.col("id").alias("__endless"), F.col("page_start").alias("__from"))
    found = rows.join(F.broadcast(page_map(sections.filter("page_end IS NOT NULL"))), "page", "left").join(F.broadcast(endless), F.col("page") >= F.col("__from"), "left")
    return found.withColumn("section", F.coalesce("section", "__endless")).drop("__endless", "__from").filter("section IS NOT NULL")


def by_page(long: DataFrame) -> DataFrame:
    """page, dim, lines and mean density over the page's lines."""
    return long.groupBy("page", "dim").agg(F.count("*").alias("lines"), exact_mean(millionths(), F.count("*")).alias("mean_density"))


def ratio_by_page(long: DataFrame, n_col: str = "n_tokens") -> DataFrame:
    """page, dim, matches per token of the whole page."""
    found = long.groupBy("page", "dim").agg(F.sum("count").alias("hits"), F.sum(n_col).alias("tokens"))
    return found.withColumn("ratio", F.when(F.col("tokens") == 0, 0.0).otherwise(F.round(F.col("hits") / F.col("tokens"), 6)))


def peaks(ratios: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` pages of each dimension, lower pages first among equals."""
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("ratio"), "page"))
    return ratios.withColumn("rank", rank).filter(F.col("rank") <= top)


def by_section(long: DataFrame, sections: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """section, dim, lines, mean, exact median and sample deviation of line densities; zeros for a section without lines.

    The median is found from the counts of distinct densities; as they have six places and lie
    between 0 and 1, a group has a million of these at most, however many lines.
    """
    found = in_section(long, sections).groupBy("section", "dim").agg(F.count("*").alias("lines"), F.avg("density").alias("m"), F.median("density").alias("md"), F.stddev_samp("density").alias("s"))
    spine = sections.select(F.col("id").alias("section"), F.explode(F.array(*map(F.lit, dims))).alias("dim"))
    zero = lambda c: F.round(F.coalesce(F.when(F.isnan(c), 0.0).otherwise(F.col(c)), F.lit(0.0)), 6)
    return spine.join(found, ["section", "dim"], "left").select("section", "dim", F.coalesce("lines", F.lit(0)).alias("lines"), zero("m").alias("mean"), zero("md").alias("median"), zero("s").alias("stdev"))


def sliding(long: DataFrame, width: int = 20) -> DataFrame:
    """window_start, window_end, dim, mean line density over the pages of each full window; zero over absent pages.

    Lines are summed by page; each page's sums then go to the windows that hold it, an aggregate with
    map-side combine. Windows run from the first page of a dimension to the last one, or are one if
    there are fewer pages.
    """
    page = long.groupBy("dim", "page").agg(millionths().alias("s"), F.count("*").alias("n"))
    reach = page.groupBy("dim").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))  # a row for each dimension
    last = F.greatest("lo", F.col("hi") - width + 1)
    parts = reach.select("dim", last.alias("last"), F.explode(F.sequence("lo", last, F.lit(1024))).alias("first"))
    spine = parts.select("dim", F.explode(F.sequence("first", F.least("last", F.col("first") + 1023))).alias("page"))
    held = page.select("dim", "s", "n", F.explode(F.sequence(F.col("page") - width + 1, F.col("page"))).alias("page")).groupBy("dim", "page").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return spine.join(held, ["dim", "page"], "left").select(F.col("page").alias("window_start"), (F.col("page") + width - 1).alias("window_end"), "dim", F.coalesce(exact_mean(F.col("s"), F.col("n")), F.lit(0.0)).alias("mean_density"))
