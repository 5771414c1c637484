"""Corpus operators: authors, validation, comparison with a second source."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Signs that each kind of discrepancy ignores.
VISHRAM_SIGNS, NASAL_SIGNS, NUKTA_SIGNS = ";,.।॥", T.BINDI + T.TIPPI, T.NUKTA + T.NUKTA_COMPOSED


def forward_fill(lines: DataFrame, header: Column, default: str, page: str = "page", order: tuple[str, ...] = ("line_number",), name: str = "author") -> DataFrame:
    """The last header value at or before each line, over all pages; ``default`` before the first.

    Within each page by a window; from page to page by ``carried``, over one row per page. Lines
    without a page are filled among themselves alone.
    """
    w = Window.partitionBy(page).orderBy(*order)
    own = lines.withColumn("__h", header).withColumn("__f", F.last("__h", ignorenulls=True).over(w))
    ends = own.filter(F.col(page).isNotNull()).groupBy(F.col(page).cast("long").alias("__k")).agg(F.max_by("__h", F.when(F.col("__h").isNotNull(), F.struct(*order))).alias("__v"))
    found = own.join(carried(ends), F.col(page) == F.col("__k"), "left")
    return found.withColumn(name, F.coalesce("__f", "__c", F.lit(default))).drop("__h", "__f", "__c", "__k")


def carried(ends: DataFrame, size: int = 4096, levels: int = 5) -> DataFrame:
    """(__k, __c): for each key of (__k, __v), the last value that is not null at a smaller key.

    Keys are cut into blocks of ``size``, the blocks into blocks, and so on: each level is a window
    over at most ``size`` rows of one block, and each higher level has a row for each block below.
    Five levels of 4096 hold all keys that are page numbers, up to 2 ** 60.
    """
    block = F.floor(F.col("__k") / size)
    before = Window.partitionBy(block).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    here = ends.select("__k", F.last("__v", ignorenulls=True).over(before).alias("__here"), block.alias("__b"))
    if levels == 1:
        return here.select("__k", F.col("__here").alias("__c"))
    above = carried(ends.groupBy(block.alias("__k")).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__k"))).alias("__v")), size, levels - 1)
    above = above.select(F.col("__k").alias("__b"), F.col("__c").alias("__above"))
    return here.join(above, "__b", "left").select("__k", F.coalesce("__here", "__above").alias("__c"))


def _cuts(texts: pa.Array, tokens: pa.Array, spans: pa.Array) -> pa.Array:
    """0: a span is not within its text; 1: all are; 2: and each cuts its token out of the text. Null without tokens, spans or a text for them; linear in the text."""
    flat = spans.flatten()
    starts, ends = (flat.field(c).to_pylist() for c in ("start", "end"))
    found, at = [], 0
    for text, words, n in zip(texts.to_pylist(), tokens.to_pylist(), spans.value_lengths().to_pylist(), strict=True):
        own, at = list(zip(starts[at : at + (n or 0)], ends[at : at + (n or 0)], strict=True)), at + (n or 0)
        if words is None or n is None or (text is None and n):
            found.append(None)
        elif not all(s is not None and e is not None and 0 <= s < e <= len(text) for s, e in own):
            found.append(0)
        else:
            found.append(2 if len(words) == n and all(text[s:e] == w for (s, e), w in zip(own, words, strict=True)) else 1)
    return pa.array(found, pa.int32())


def validate(lines: DataFrame, renormalized: Column, key: str = "line_uid", text: str = "text", versions: tuple[str, ...] = ("1.0.0",), longest: int = 200) -> DataFrame:
    """(check, failures, passed) of each corpus check, in one pass and one aggregate of ids."""
    n, spans = F.size("tokens"), F.size("token_spans")
    lines = lines.withColumn("__cut", F.arrow_udf(_cuts, "int")(F.col(text), F.col("tokens"), F.col("token_spans")))
    inside, whole = F.col("__cut") >= 1, F.col("__cut") == 2
    checks = {
        "non_empty_text": F.trim(F.coalesce(F.col(text), F.lit(""))) == "",
        "normalization_idempotent": ~renormalized.eqNullSafe(F.col(text)),
        "schema_version_present": F.col("schema_version").isNull(),
        "schema_version_supported": F.col("schema_version").isNotNull() & ~F.col("schema_version").isin(*versions),
        "token_count_sane": (n == 0) | (n > longest),
        "expected_characters": F.col(text).rlike(f"[^{T.EXPECTED}]"),
        "token_span_counts": n != spans,
        "token_spans_valid": (n == spans) & ~inside,
        "token_spans_match": (n == spans) & inside & ~whole,
    }
    flat = lines.agg(*(F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in checks.items()))
    found = flat.unpivot([], list(checks), "check", "failures")
    twice = lines.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").agg(F.lit("unique_line_uid").alias("check"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("failures"))
    return found.unionByName(twice).withColumn("passed", F.col("failures") == 0)


def discrepancy(a: Column, b: Column) -> Column:
    """Kind of difference of two texts, most harmless first; null if they are equal."""
    same = lambda signs: F.split(T.collapse(F.translate(a, signs, "")), " ") == F.split(T.collapse(F.translate(b, signs, "")), " ")
    return F.when(a == b, F.lit(None).cast("string")).when(same(""), "whitespace_only").when(same(VISHRAM_SIGNS), "vishram_only").when(same(NASAL_SIGNS), "nasal_only").when(same(NUKTA_SIGNS), "nukta_only").otherwise("substantive")


def compare(primary: DataFrame, secondary: DataFrame, keys: tuple[str, ...] = ("page", "line_index")) -> DataFrame:
    """keys, primary_text, secondary_text, match, discrepancy: by position, lines of either side alone included."""
    both = primary.select(*keys, F.col("text").alias("primary_text")).join(secondary.select(*keys, F.col("text").alias("secondary_text")), [*keys], "full_outer")
    kind = F.when(F.col("primary_text").isNull(), "extra_line").when(F.col("secondary_text").isNull(), "missing_line").otherwise(discrepancy(F.col("primary_text"), F.col("secondary_text")))
    return both.withColumn("discrepancy", kind).withColumn("match", F.col("discrepancy").isNull())


def comparison_report(compared: DataFrame) -> DataFrame:
    """kind, n, share of all positions; "match" counts the equal ones."""
    counts = compared.groupBy(F.coalesce("discrepancy", F.lit("match")).alias("kind")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("kind", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))
