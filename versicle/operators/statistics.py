"""Statistics: support, smoothed log odds, effect size, bootstrap intervals."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def supported(n: Column, least: int = 20) -> Column:
    return n >= least


def log_odds(c: Column, n: Column, C: Column, N: Column, prior: float = 0.5) -> Column:
    """Log odds of a word in a group against the background, smoothed; 0 where a denominator is not positive."""
    c, n, C, N = (x.cast("double") for x in (c, n, C, N))
    a, b = n - c + prior, N - C + prior
    return F.when((a <= 0) | (b <= 0) | (C + prior <= 0), 0.0).otherwise(F.ln(((c + prior) / a) / ((C + prior) / b)))


def cohens_d(values: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """One row: counts, means, pooled deviation, d and its size in words; 0 with under two values in a group or no spread."""
    g = values.filter(F.col(group).isin(a, b)).agg(*(f(F.when(F.col(group) == x, F.col(value))).alias(f"{name}_{s}") for x, s in ((a, "a"), (b, "b")) for f, name in ((F.count, "n"), (F.avg, "mean"), (F.var_samp, "var"))))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2))
    few = (F.col("n_a") < 2) | (F.col("n_b") < 2)
    found = g.withColumn("pooled", F.when(few, 0.0).otherwise(pooled))
    d = F.when(few | (F.col("pooled") == 0), 0.0).otherwise((F.col("mean_a") - F.col("mean_b")) / F.col("pooled"))
    size = F.abs(F.col("d"))
    label = F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")
    return found.withColumn("d", d).select("n_a", "n_b", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), F.round("pooled", 6).alias("pooled"), F.round("d", 6).alias("d"), label.alias("effect"))


def bootstrap_ci(values: DataFrame, group: str, value: str, samples: int = 1000, alpha: float = 0.05, seed: int = 42, parts: int = 64) -> DataFrame:
    """group, n, mean, ci_low, ci_high: percentile interval of the mean.

    Groups of any size stay spread out: each row draws its number of occurrences in every resample
    from a Poisson distribution of mean one, seeded by its part of the group, and only the parts'
    sums and counts (one array per part and group) are combined. A group of one gives its value; a
    group without values zeros.
    """
    import numpy as np

    part = F.pmod(F.xxhash64(group, value), F.lit(parts))
    rows = values.select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v"), part.alias("part")).groupBy("g", "v", "part").agg(F.count("v").alias("n"))
    rows = rows.sortWithinPartitions("g", "part", "v")  # a task that runs again draws the same

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (g, p), own in batch.groupby(["g", "part"], dropna=False):
                own = own[own["n"] > 0]
                v, n = own["v"].to_numpy(), own["n"].to_numpy()
                rng = np.random.default_rng([seed, int(p), zlib.crc32(v.tobytes())])
                sums, counts = np.zeros(samples), np.zeros(samples)
                for i in range(0, len(v), 256):
                    drawn = rng.poisson(n[i : i + 256, None], (len(v[i : i + 256]), samples))
                    sums += v[i : i + 256] @ drawn
                    counts += drawn.sum(axis=0)
                out.append((g, int(n.sum()), float((v * n).sum()), sums.tolist(), counts.tolist()))
            yield pd.DataFrame(out, columns=["g", "n", "total", "sums", "counts"])

    partial = rows.mapInPandas(draw, "g string, n long, total double, sums array<double>, counts array<double>")
    each = partial.select("g", "n", "total", F.posexplode(F.arrays_zip("sums", "counts")).alias("i", "x"))
    drawn = each.groupBy("g", "i").agg(F.sum("x.sums").alias("s"), F.sum("x.counts").alias("c"))
    means = drawn.groupBy("g").agg(F.sort_array(F.collect_list(F.when(F.col("c") > 0, F.col("s") / F.col("c")))).alias("means"))
    whole = partial.groupBy("g").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    at = lambda share, up: F.try_element_at("means", F.greatest(F.lit(1), F.least(F.size("means"), (F.ceil(F.size("means") * share) if up else F.floor(F.size("means") * share) + 1).cast("int"))))
    found = whole.join(means, "g").withColumn("mean", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0))
    bound = lambda share, up: F.when(F.col("n") <= 1, F.col("mean")).otherwise(at(share, up))
    return found.select(F.col("g").alias(group), "n", F.round("mean", 6).alias("mean"), F.round(bound(F.lit(alpha / 2), False), 6).alias("ci_low"), F.round(bound(F.lit(1 - alpha / 2), True), 6).alias("ci_high"))
