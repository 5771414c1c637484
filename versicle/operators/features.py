"""Line features: counts, densities and matched forms by dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import density, percent
from .density import exact_mean, millionths
from .lexicon import DIMENSIONS


def long_features(lines: DataFrame, matches: DataFrame, bridge: DataFrame, keys: tuple[str, ...] = ("line_uid",), n_col: str = "n_tokens") -> DataFrame:
    """keys, dim, count, density, forms of each line and dimension with a match that is not nested."""
    own = matches.filter(F.col("nested_in").isNull()).join(F.broadcast(bridge), "entity_id")  # entities times dimensions: the lexicon's size
    counted = own.groupBy(*keys, "dim").agg(F.count("*").alias("count"), F.sort_array(F.collect_list(F.struct("start", "form"))).alias("__f"))
    found = counted.join(lines.select(*keys, n_col), [*keys])
    return found.select(*keys, "dim", "count", density(F.col("count"), F.col(n_col)).alias("density"), F.col("__f.form").alias("forms"))


def wide_features(lines: DataFrame, matches: DataFrame, bridge: DataFrame, keys: tuple[str, ...] = ("line_uid",), keep: tuple[str, ...] = (), n_col: str = "n_tokens") -> DataFrame:
    """Every line with one count column per dimension, zero where it has none."""
    own = matches.filter(F.col("nested_in").isNull()).join(F.broadcast(bridge), "entity_id")
    counts = own.groupBy(*keys).agg(*(F.count_if(F.col("dim") == d).alias(d) for d in DIMENSIONS))
    joined = lines.select(*keys, *keep, n_col).join(counts, [*keys], "left")
    return joined.select(*keys, *keep, n_col, *(F.coalesce(d, F.lit(0)).alias(d) for d in DIMENSIONS))


def line_counts(matched: DataFrame, dims: dict[str, tuple[str, ...]], keep: tuple[str, ...] = ("line_uid",), n_col: str = "n_tokens") -> DataFrame:
    """As ``wide_features``, for lines that carry their matches (``matching.matched``): nothing is joined or shuffled."""
    own = matched.select(*keep, n_col, F.transform(F.filter("matches", lambda m: m["nested_in"].isNull()), lambda m: m["entity_id"]).alias("__e"))
    count = lambda ids: F.size(F.filter("__e", lambda e: e.isin(*ids))) if ids else F.lit(0)
    return own.select(*keep, n_col, *(count(dims.get(d, ())).cast("long").alias(d) for d in DIMENSIONS))


def unpivoted(wide: DataFrame, keys: tuple[str, ...], n_col: str = "n_tokens") -> DataFrame:
    """keys, n_tokens, dim, count, density with a row for every dimension of every line."""
    long = wide.unpivot([*keys, n_col], list(DIMENSIONS), "dim", "count")
    return long.withColumn("density", density(F.col("count"), F.col(n_col)))


def dimension_summary(wide: DataFrame, n_col: str = "n_tokens") -> DataFrame:
    """dim, hits, lines with a hit, their share in percent, mean and greatest density."""
    long = unpivoted(wide, (), n_col)
    return long.groupBy("dim").agg(
        F.sum("count").alias("hits"), F.count_if(F.col("count") > 0).alias("lines_hit"), F.round(percent(F.count_if(F.col("count") > 0), F.count("*")), 2).alias("pct_lines"), exact_mean(millionths(), F.count("*")).alias("avg_density"), F.max("density").alias("max_density")
    )
