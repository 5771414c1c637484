"""Evaluation of predicted labels against gold ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import percent

GOLD = "line_uid string, category string, secondary_categories array<string>, confidence string, annotator string, notes string"


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def joined(gold: DataFrame, predicted: DataFrame, key: str = "line_uid") -> DataFrame:
    """key, gold, pred; pred is MISSING without a prediction row and "unclassified" for a null one."""
    g = gold.select(key, F.col("category").alias("gold"))
    p = predicted.select(key, F.coalesce("primary_tag", F.lit("unclassified")).alias("pred"))
    return g.join(p, key, "left").select(key, "gold", F.coalesce("pred", F.lit("MISSING")).alias("pred"))


def category_metrics(both: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """category, tp, fp, fn, support, precision, recall, f1 of every label in gold or prediction (not MISSING)."""
    pairs = both.groupBy(*by, "gold", "pred").agg(F.count("*").alias("n"))
    each = F.array(F.struct(F.col("gold").alias("category"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("gold") != F.col("pred"), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col("pred").alias("category"), F.lit(0).cast("long").alias("tp"), F.when(F.col("gold") != F.col("pred"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")))
    flat = pairs.select(*by, F.explode(each).alias("x")).select(*by, "x.*").filter(F.col("category") != "MISSING")
    found = flat.groupBy(*by, "category").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    found = found.select("*", (F.col("tp") + F.col("fn")).alias("support"), p.alias("precision"), r.alias("recall"))
    return found.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def macro(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean precision and recall over categories with support, and the F1 of those two means."""
    found = metrics.filter(F.col("support") > 0).groupBy(*by).agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.count("*").alias("categories"))
    return found.select(*by, "categories", F.round("p", 6).alias("macro_precision"), F.round("r", 6).alias("macro_recall"), F.round(f1(F.col("p"), F.col("r")), 6).alias("macro_f1"))


def confusion(both: DataFrame) -> DataFrame:
    return both.groupBy("gold", "pred").agg(F.count("*").alias("n"))


def errors(both: DataFrame) -> DataFrame:
    return both.filter(~F.col("gold").eqNullSafe(F.col("pred")))


def sweep(gold: DataFrame, variants: DataFrame) -> DataFrame:
    """Macro metrics of every variant of ``rederive``."""
    return labelled_sweep(gold.select("line_uid", F.col("category").alias("gold")).join(variants, "line_uid"))


def labelled_sweep(variants: DataFrame) -> DataFrame:
    """As ``sweep``, for rows of ``rederive`` that carry their ``gold`` label: nothing is joined."""
    both = variants.select("variant", "gold", F.coalesce("primary_tag", F.lit("unclassified")).alias("pred"))
    return macro(category_metrics(both, ("variant",)), ("variant",))


def proportional_sample(lines: DataFrame, target: int, stratum: str = "author", seed: int = 42, key: str = "line_uid") -> DataFrame:
    """``target`` lines, from each stratum its share (one at least), filled from the rest and cut at ``target``.

    Order is by a seeded hash. The quota rows are bounded by the target; ranks within a stratum are
    found over the rows below a hash bound that holds the quota, not over the whole stratum.
    """
    hashed = lines.withColumn("__h", F.xxhash64(F.lit(seed), key)).withColumn("__s", F.coalesce(stratum, F.lit("unknown")))
    counts = hashed.groupBy("__s").agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"))
    quota = counts.join(F.broadcast(total)).select("__s", "__n", F.least("__n", F.greatest(F.lit(1), F.round(F.col("__n") / F.col("__t") * target).cast("long"))).alias("__q"))
    share = (F.col("__h") / F.lit(2.0**64) + 0.5)
    near = hashed.join(F.broadcast(quota), "__s").filter(share <= (F.col("__q") + 10 * F.sqrt("__q") + 20) / F.col("__n"))
    rank = F.row_number().over(Window.partitionBy("__s").orderBy("__h", key))
    chosen = near.withColumn("__r", rank).withColumn("__late", (F.col("__r") > F.col("__q")).cast("int"))
    return chosen.orderBy("__late", "__h", key).limit(target).select(*lines.columns)


def page_sample(total: int, size: int, seed: int = 42) -> list[int]:
    """One random page of each of ``size`` equal strata of 1..total, ascending, repeats once."""
    import random

    rng, step = random.Random(seed), total / size if size else 0
    return sorted({rng.randint(int(i * step) + 1, max(int(i * step) + 1, min(int((i + 1) * step), total))) for i in range(min(size, total))})


def first_pages(lines: DataFrame, size: int, page: str = "page") -> DataFrame:
    """The first page with lines of each of ``size`` equal strata of 1 to the last page."""
    pages = lines.select(page).distinct()
    last = pages.agg(F.max(page).alias("__last"))  # one row
    stratum = F.floor((F.col(page) - 1) * size / F.col("__last"))
    return pages.join(F.broadcast(last)).groupBy(stratum.alias("__s")).agg(F.min(page).alias(page)).select(page)


def report(metrics: DataFrame) -> DataFrame:
    """Per category and a MACRO row, for writing as CSV."""
    m = macro(metrics).select(F.lit("MACRO").alias("category"), *(F.lit(None).cast("long").alias(c) for c in ("tp", "fp", "fn", "support")), F.col("macro_precision").alias("precision"), F.col("macro_recall").alias("recall"), F.col("macro_f1").alias("f1"))
    return metrics.unionByName(m)


__all__ = ["GOLD", "category_metrics", "confusion", "errors", "f1", "first_pages", "joined", "labelled_sweep", "macro", "page_sample", "percent", "proportional_sample", "ratio", "report", "sweep"]
