"""Counts, rates and profiles for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bucket, percent, rate
from .density import in_section
from .lexicon import DIMENSIONS


def own(matches: DataFrame, include_nested: bool = False) -> DataFrame:
    return matches if include_nested else matches.filter(F.col("nested_in").isNull())


def entity_counts(matches: DataFrame, lines: DataFrame, entities: DataFrame, key: str = "line_uid", n_col: str = "n_tokens") -> DataFrame:
    """entity_id, category, count, lines, per 1,000 lines, per 10,000 tokens; an unknown entity has an empty category."""
    counts = own(matches).groupBy("entity_id").agg(F.count("*").alias("count"), F.countDistinct(key).alias("lines"))
    size = lines.agg(F.count("*").alias("L"), F.sum(n_col).alias("T"))
    found = counts.join(F.broadcast(entities.select(F.col("id").alias("entity_id"), "category")), "entity_id", "left").join(F.broadcast(size))
    return found.select("entity_id", F.coalesce("category", F.lit("")).alias("category"), "count", "lines", rate(F.col("count"), F.col("L"), 1000).alias("per_1000_lines"), rate(F.col("count"), F.col("T"), 10000).alias("per_10000_tokens"))


def by_bucket(matches: DataFrame, size: int = 100) -> DataFrame:
    return own(matches).groupBy("entity_id", bucket(F.col("page"), size).alias("bucket")).agg(F.count("*").alias("count"))


def by_section(matches: DataFrame, sections: DataFrame) -> DataFrame:
    """Counts by section; the page intervals are joined as a page map, an equi-join."""
    return in_section(own(matches), sections).groupBy("entity_id", "section").agg(F.count("*").alias("count"))


def by_column(matches: DataFrame, column: str) -> DataFrame:
    return own(matches).groupBy("entity_id", F.coalesce(column, F.lit("unknown")).alias(column)).agg(F.count("*").alias("count"))


def match_stats(matches: DataFrame, key: str = "line_uid") -> DataFrame:
    return matches.agg(
        F.count("*").alias("matches"), F.count_if(F.col("nested_in").isNotNull()).alias("nested"), F.count_if(F.col("confidence") == "HIGH").alias("high"), F.count_if(F.col("confidence") == "MEDIUM").alias("medium"), F.countDistinct(key).alias("lines"), F.countDistinct("entity_id").alias("entities")
    )


def corpus_stats(lines: DataFrame, group: str = "group_id", n_col: str = "n_tokens") -> DataFrame:
    return lines.agg(F.count("*").alias("lines"), F.countDistinct("page").alias("pages"), F.countDistinct(group).alias("groups"), F.sum(n_col).alias("tokens"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def top(counts: DataFrame, n: int, by: str = "count", name: str = "entity_id", within: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` greatest, names breaking ties; per group where ``within`` is given."""
    if not within:
        return counts.orderBy(F.desc(by), name).limit(n)
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(by), name))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def author_profile(wide: DataFrame, by: str = "author") -> DataFrame:
    """by, lines and percent of lines with each dimension."""
    return wide.groupBy(by).agg(F.count("*").alias("lines"), *(F.round(percent(F.count_if(F.col(d) > 0), F.count("*")), 2).alias(f"pct_{d}") for d in DIMENSIONS))


def mixing(wide: DataFrame, a: str, b: str) -> DataFrame:
    """Lines with both, with one alone, and both as a percentage of lines with either."""
    x, y = F.col(a) > 0, F.col(b) > 0
    found = wide.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"))
    return found.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "*", percent(F.col("both"), F.col("both") + F.col("only_a") + F.col("only_b")).alias("rate"))


def composite(matches: DataFrame, sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """Total matches of each named entity set."""
    return own(matches).agg(*(F.count_if(F.col("entity_id").isin(*ids)).alias(name) for name, ids in sets.items()))
