"""Co-occurrence of entities in windows, with association measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage


def window_entities(matches: DataFrame, window: Column | str, include_nested: bool = False) -> DataFrame:
    """Distinct (w, entity_id) of matches that are not nested."""
    own = matches if include_nested else matches.filter(F.col("nested_in").isNull())
    return own.select((F.col(window) if isinstance(window, str) else window).alias("w"), "entity_id").filter(F.col("w").isNotNull()).distinct()


def pmi(ab: Column, a: Column, b: Column, n: Column) -> Column:
    ok = (ab > 0) & (a > 0) & (b > 0) & (n > 0)
    return F.when(ok, F.log2(ab.cast("double") * n.cast("double") / (a.cast("double") * b.cast("double")))).otherwise(0.0)


def smoothed_pmi(ab: Column, a: Column, b: Column, n: Column, v: Column, k: float) -> Column:
    kv = F.lit(float(k)) * v.cast("double")
    top = (ab.cast("double") + F.lit(float(k))) * (n.cast("double") + kv * v.cast("double"))
    return F.log2(top / ((a.cast("double") + kv) * (b.cast("double") + kv)))


def npmi(value: Column, p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(value / -F.log2(p))


def jaccard(ab: Column, a: Column, b: Column) -> Column:
    union = (a + b - ab).cast("double")
    return F.when(union <= 0, 0.0).otherwise(ab / union)


def pairs(windows: DataFrame, min_freq: int = 1, min_count: int = 1, smoothing: float = 0.0, min_support: int = 0) -> DataFrame:
    """entity_a < entity_b, raw_count, pmi, npmi, jaccard over (w, entity_id) rows.

    Entities in fewer than ``min_freq`` windows go before pairs are formed; the number of windows N
    and of entities V count what is left. Pairs in fewer than ``min_count`` windows go; below
    ``min_support`` pmi and npmi are null. A window's pairs number the square of its distinct
    entities, which the lexicon bounds, not the corpus. Windows are read once, into counts of the
    distinct sets of entities; all figures come from these.
    """
    sets = windows.filter(F.col("w").isNotNull() & F.col("entity_id").isNotNull()).groupBy("w").agg(F.sort_array(F.collect_set("entity_id")).alias("e"))
    alike = stage(sets.groupBy("e").agg(F.count("*").alias("n")), "windows")  # windows with the same entities are one row
    counts = alike.select(F.explode("e").alias("entity_id"), "n").groupBy("entity_id").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_freq)
    if min_freq > 1:  # one row per lexicon entity
        kept = F.broadcast(counts.agg(F.collect_set("entity_id").alias("__kept")))
        alike = alike.join(kept).select(F.array_intersect("e", "__kept").alias("e"), "n").filter(F.size("e") > 0)
    total = alike.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N")).join(F.broadcast(counts.agg(F.count("*").alias("V"))))
    each = alike.select("n", F.explode(F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, F.greatest(F.size("e") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    both = each.groupBy(F.col("p.a").alias("entity_a"), F.col("p.b").alias("entity_b")).agg(F.sum("n").alias("raw_count")).filter(F.col("raw_count") >= min_count)
    found = both.join(F.broadcast(counts.select(F.col("entity_id").alias("entity_a"), F.col("n").alias("na"))), "entity_a")
    found = found.join(F.broadcast(counts.select(F.col("entity_id").alias("entity_b"), F.col("n").alias("nb"))), "entity_b").join(F.broadcast(total))
    ab, a, b, n, v = (F.col(c) for c in ("raw_count", "na", "nb", "N", "V"))
    if smoothing > 0:
        value, p = smoothed_pmi(ab, a, b, n, v, smoothing), (ab + F.lit(float(smoothing))) / (n + F.lit(float(smoothing)) * v * v)
    else:
        value, p = pmi(ab, a, b, n), ab / n.cast("double")
    enough = ab >= min_support
    return found.select("entity_a", "entity_b", "raw_count", F.when(enough, F.round(value, 6)).alias("pmi"), F.when(enough, F.round(npmi(value, p), 6)).alias("npmi"), F.round(jaccard(ab, a, b), 6).alias("jaccard"))


def levels(matches: DataFrame, by: dict[str, str], **options) -> DataFrame:
    """``pairs`` of several window levels, with the level's name; the matches are made once."""
    own = stage(matches.filter(F.col("nested_in").isNull()).select(*dict.fromkeys(by.values()), "entity_id", "nested_in"), "own")
    found = None
    for name, column in by.items():
        one = pairs(window_entities(own, column), **options).withColumn("window_level", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


def cross_group(pairs_: DataFrame, entities: DataFrame, group: str = "tradition") -> DataFrame:
    """Pairs whose entities have different, known groups; best npmi first, nulls last, then count, then names."""
    side = lambda x: F.broadcast(entities.select(F.col("id").alias(f"entity_{x}"), F.col(group).alias(f"{group}_{x}")))
    found = pairs_.join(side("a"), "entity_a").join(side("b"), "entity_b").filter(F.col(f"{group}_a") != F.col(f"{group}_b"))
    return found.orderBy(F.desc_nulls_last("npmi"), F.desc("raw_count"), "entity_a", "entity_b")


def group_pairs(crossed: DataFrame, group: str = "tradition") -> DataFrame:
    label = F.concat_ws("+", F.least(f"{group}_a", f"{group}_b"), F.greatest(f"{group}_a", f"{group}_b"))
    return crossed.groupBy(label.alias("groups")).agg(F.count("*").alias("n"))


def negated_lines(lines: DataFrame, matches: DataFrame, ritual: list[str], negations: list[str], keys: tuple[str, ...] = ("line_uid",), tokens_col: str = "tokens") -> DataFrame:
    """Lines that hold one of the ``ritual`` entities and a negation word, with both sets in order."""
    own = matches.filter(F.col("nested_in").isNull() & F.col("entity_id").isin(*ritual)).groupBy(*keys).agg(F.array_sort(F.collect_set("entity_id")).alias("ritual_entities"))
    said = lines.select(*keys, F.array_sort(F.array_distinct(F.filter(tokens_col, lambda t: t.isin(*negations)))).alias("negation_tokens")).filter(F.size("negation_tokens") > 0)
    return said.join(own, [*keys])


def negated(matched: DataFrame, ritual: list[str], negations: list[str], keys: tuple[str, ...] = ("line_uid",), tokens_col: str = "tokens") -> DataFrame:
    """As ``negated_lines``, for lines that carry their matches (``matching.matched``): one scan, nothing is joined or shuffled."""
    said = F.array_sort(F.array_distinct(F.filter(tokens_col, lambda t: t.isin(*negations))))
    own = F.filter("matches", lambda m: m["nested_in"].isNull() & m["entity_id"].isin(*ritual))
    found = matched.select(*keys, F.array_sort(F.array_distinct(F.transform(own, lambda m: m["entity_id"]))).alias("ritual_entities"), said.alias("negation_tokens"))
    return found.filter((F.size("ritual_entities") > 0) & (F.size("negation_tokens") > 0))


def focal(matches: DataFrame, entity: str, key: str = "line_uid", top: int = 20) -> DataFrame:
    """The ``top`` entities that share most lines with ``entity`` (names break ties)."""
    sets = window_entities(matches, key)
    with_it = sets.filter(F.col("entity_id") == entity).select("w")
    return sets.filter(F.col("entity_id") != entity).join(with_it, "w", "left_semi").groupBy("entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").limit(top)
