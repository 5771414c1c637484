"""Rule scores with group context, and the tags derived from them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bucket, density, percent, sigmoid
from ..staging import stage


@dataclass(frozen=True)
class Rule:
    """One scoring rule: of the four conditions the first that is set decides."""

    weight: float
    match_entity: tuple[str, ...] = ()
    match_register: str | None = None
    has_negation_of_form: bool = False
    co_occurs_negation: bool = False

    def fires(self) -> Column:
        if self.match_entity:
            return F.arrays_overlap("entity_ids", F.array(*map(F.lit, self.match_entity)))
        if self.match_register is not None:
            return F.coalesce(F.try_element_at("densities", F.lit(self.match_register)), F.lit(0.0)) > 0
        if self.has_negation_of_form:
            return F.col("has_negation")
        return F.col("ritual_negation") if self.co_occurs_negation else F.lit(False)

    def label(self, i: int) -> str:
        if self.match_entity:
            return "match_entity:" + ",".join(self.match_entity)
        if self.match_register is not None:
            return f"match_register:{self.match_register}"
        return "has_negation_of_form" if self.has_negation_of_form else "co_occurs_negation" if self.co_occurs_negation else f"rule_{i}"

    def evidence(self) -> Column:
        """The first matched form of the rule's entities on the line, or words for the condition."""
        if self.match_entity:
            own = F.filter("line_matches", lambda m: m["entity_id"].isin(*self.match_entity))
            return F.coalesce(F.try_element_at(own, F.lit(1))["form"], F.lit(",".join(self.match_entity)))
        if self.match_register is not None:
            value = F.coalesce(F.try_element_at("densities", F.lit(self.match_register)), F.lit(0.0))
            return F.concat(F.lit(f"register:{self.match_register}="), F.format_string("%.2f", value))
        return F.lit("negation_of_form" if self.has_negation_of_form else "ritual+negation")


@dataclass(frozen=True)
class Dimension:
    name: str
    rules: tuple[Rule, ...]
    k: float = 2.0
    x0: float = 1.5


@dataclass(frozen=True)
class Scoring:
    dimensions: tuple[Dimension, ...]
    context_weight: float = 0.2

    def registers(self) -> set[str]:
        """The dimensions whose densities rules or their evidence ask for."""
        return {r.match_register for d in self.dimensions for r in d.rules if r.match_register is not None}

    @staticmethod
    def parse(config: dict) -> Scoring:
        """From the ``tagging`` part of a configuration document."""
        dims = []
        for name, d in (config.get("dimensions") or {}).items():
            rules = tuple(
                Rule(float(r.get("weight", 0.0)), tuple(r.get("match_entity") or ()), r.get("match_register"), bool(r.get("has_negation_of_form")), bool(r.get("co_occurs_negation"))) for r in d.get("rules") or []
            )
            dims.append(Dimension(name, rules, float(d.get("sigmoid_k", 2.0)), float(d.get("sigmoid_x0", 1.5))))
        return Scoring(tuple(dims), float(config.get("context_weight", 0.2)))


@dataclass(frozen=True)
class Thresholds:
    nirgun_min: float = 0.6
    sagun_max: float = 0.3
    sagun_min: float = 0.6
    nirgun_max: float = 0.3
    mixed_both: float = 0.2
    mixed_difference: float = 0.3
    secondary: dict[str, float] = field(default_factory=lambda: {"universalism": 0.5, "critique_ritual": 0.5, "critique_clerics": 0.5})

    @staticmethod
    def parse(config: dict) -> Thresholds:
        t = config.get("thresholds") or {}
        get = lambda a, b, d: float((t.get(a) or {}).get(b, d))
        return Thresholds(
            get("nirgun_leaning", "nirgun_min", 0.6), get("nirgun_leaning", "sagun_max", 0.3), get("sagun_narrative_leaning", "sagun_min", 0.6), get("sagun_narrative_leaning", "nirgun_max", 0.3), get("mixed", "both_min", 0.2), get("mixed", "difference_max", 0.3),
            {x: get(x, "min", 0.5) for x in ("universalism", "critique_ritual", "critique_clerics")},
        )


def contexts(lines: DataFrame, matches: DataFrame, long: DataFrame, negations: tuple[str, ...] = ("NEGATION", "NEG_"), rituals: tuple[str, ...] = ("RITUAL", "TEERATH", "POOJA", "JANEYU", "TILAK"), keys: tuple[str, ...] = ("line_uid",), keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines with entity_ids, line_matches, densities, has_negation and ritual_negation.

    Entity ids that contain one of the given words are negations or rituals; nested matches count
    for nothing. One shuffle of matches and one of densities, by line.
    """
    has = lambda xs: F.exists("entity_ids", lambda e: reduce(lambda a, b: a | b, [F.upper(e).contains(x) for x in xs]))
    own = matches.filter(F.col("nested_in").isNull()).groupBy(*keys).agg(F.collect_set("entity_id").alias("e"), F.sort_array(F.collect_list(F.struct("start", "alias_ord", "entity_id", "form"))).alias("m"))
    dense = long.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("dim", "density"))).alias("d"))
    found = lines.select(*keys, *keep).join(own, [*keys], "left").join(dense, [*keys], "left")
    empty = own.schema["m"].dataType.simpleString()
    found = found.select(*keys, *keep, F.coalesce("e", F.array().cast("array<string>")).alias("entity_ids"), F.coalesce("m", F.array().cast(empty)).alias("line_matches"), F.coalesce("d", F.create_map().cast("map<string,double>")).alias("densities"))
    return found.select("*", has(negations).alias("has_negation"), (has(negations) & has(rituals)).alias("ritual_negation"))


def line_contexts(matched: DataFrame, dims: dict[str, tuple[str, ...]], negations: tuple[str, ...] = ("NEGATION", "NEG_"), rituals: tuple[str, ...] = ("RITUAL", "TEERATH", "POOJA", "JANEYU", "TILAK"), keep: tuple[str, ...] = ("line_uid",), n_col: str = "n_tokens") -> DataFrame:
    """As ``contexts``, for lines that carry their matches (``matching.matched``): nothing is joined or shuffled."""
    has = lambda xs: F.exists("entity_ids", lambda e: reduce(lambda a, b: a | b, [F.upper(e).contains(x) for x in xs]))
    own = F.filter("matches", lambda m: m["nested_in"].isNull())
    found = matched.select(*keep, n_col, F.sort_array(F.transform(own, lambda m: F.struct(m["start"], m["alias_ord"], m["entity_id"], m["form"]))).alias("line_matches"))
    count = lambda ids: F.size(F.filter("line_matches", lambda m: m["entity_id"].isin(*ids)))
    each = [F.struct(F.lit(d).alias("dim"), density(count(ids), F.col(n_col)).alias("density")) for d, ids in dims.items() if ids]
    dense = F.map_from_entries(F.filter(F.array(*each), lambda x: x["density"] > 0)) if each else F.create_map().cast("map<string,double>")
    found = found.select(*keep, F.array_distinct(F.transform("line_matches", lambda m: m["entity_id"])).alias("entity_ids"), "line_matches", dense.alias("densities"))
    return found.select("*", has(negations).alias("has_negation"), (has(negations) & has(rituals)).alias("ritual_negation"))


def scores(context: DataFrame, config: Scoring, group: str = "group_id", skewed: bool = True, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``context``, or its columns ``keep``, with raw_, ctx_, comb_ and score_ columns of every dimension.

    A line's context is the mean raw signal of its group, itself included; 0 in a group of one and
    for a null group. Means come from an aggregate with map-side combine and a join, so that a
    group of any size stays spread out. Both read the raw signals as written once: the lines are
    matched a single time.
    """
    raw = {d.name: reduce(lambda a, b: a + b, [F.when(r.fires(), F.lit(r.weight)).otherwise(0.0) for r in d.rules], F.lit(0.0)) for d in config.dimensions}
    kept = context.columns if keep is None else [group, *(c for c in keep if c != group)]
    base = stage(context.select(*kept, *(c.alias(f"raw_{n}") for n, c in raw.items())), "signals")
    means = base.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("__n"), *(F.avg(f"raw_{n}").alias(f"__{n}") for n in raw))
    found = base.join(means, group, "left")
    cw = config.context_weight
    for d in config.dimensions:
        ctx = F.when(F.col("__n") > 1, F.col(f"__{d.name}")).otherwise(0.0)
        comb = F.lit(1 - cw) * F.col(f"raw_{d.name}") + F.lit(cw) * ctx
        found = found.withColumns({f"ctx_{d.name}": ctx, f"comb_{d.name}": comb, f"score_{d.name}": sigmoid(comb, d.k, d.x0)})
    return found.drop("__n", *(f"__{n}" for n in raw))


def primary_tag(nirgun: Column, sagun: Column, t: Thresholds = Thresholds()) -> Column:
    both = (nirgun >= t.mixed_both) & (sagun >= t.mixed_both) & (F.abs(nirgun - sagun) <= t.mixed_difference)
    leaning = F.when((nirgun >= t.nirgun_min) & (sagun < t.sagun_max), "nirgun_leaning")
    return leaning.when((sagun >= t.sagun_min) & (nirgun < t.nirgun_max), "sagun_narrative_leaning").when(both, "mixed")


def secondary_tags(score: dict[str, Column], t: Thresholds = Thresholds()) -> Column:
    return F.array_compact(F.array(*(F.when(score[n] >= low, n) for n, low in t.secondary.items() if n in score))) if score else F.array().cast("array<string>")


def tag(scored: DataFrame, config: Scoring, t: Thresholds = Thresholds()) -> DataFrame:
    """``scored`` with primary_tag, secondary_tags, rules_fired, evidence_tokens and score_breakdown.

    The trail lists rules of positive weight that fired, by dimension and rule order, repeats once.
    """
    score = {d.name: F.col(f"score_{d.name}") for d in config.dimensions}
    fired = {d.name: F.array_compact(F.array(*(F.when(r.fires(), F.struct(F.lit(r.label(i)).alias("rule"), F.lit(r.weight).alias("weight"), r.evidence().alias("matched"))) for i, r in enumerate(d.rules) if r.weight > 0))) for d in config.dimensions if any(r.weight > 0 for r in d.rules)}
    kind = "array<struct<rule:string,weight:double,matched:string>>"
    found = scored.select("*", primary_tag(score.get("nirgun", F.lit(0.0)), score.get("sagun_narrative", F.lit(0.0)), t).alias("primary_tag"), secondary_tags(score, t).alias("secondary_tags"), *(c.cast(kind).alias(f"__{n}") for n, c in fired.items()))
    trail = F.concat(*(F.col(f"__{n}") for n in fired)) if fired else F.array().cast(kind)
    breakdown = F.map_from_arrays(F.array(*(F.lit(d.name) for d in config.dimensions)), F.array(*(F.col(f"__{d.name}") if d.name in fired else F.array().cast(kind) for d in config.dimensions)))
    found = found.select("*", F.array_distinct(F.transform(trail, lambda x: x["rule"])).alias("rules_fired"), F.array_distinct(F.transform(trail, lambda x: x["matched"])).alias("evidence_tokens"), breakdown.alias("score_breakdown"))
    return found.drop(*(f"__{n}" for n in fired))


def rederive(scored: DataFrame, variants: dict[str, Thresholds], keep: tuple[str, ...] = ("line_uid",)) -> DataFrame:
    """keep, variant, primary_tag: one row per line and variant with the tag under it, the rows times the (few) variants, nothing joined."""
    nirgun, sagun = F.col("score_nirgun"), F.col("score_sagun_narrative")
    each = F.array(*(F.struct(F.lit(n).alias("variant"), primary_tag(nirgun, sagun, t).alias("primary_tag")) for n, t in variants.items()))
    return scored.select(*keep, F.explode(each).alias("v")).select(*keep, "v.variant", "v.primary_tag")


def register_tag() -> Column:
    """The ten-way tag from counts by dimension, first that applies."""
    c = {d: F.col(d) > 0 for d in ("nirgun", "sagun_narrative", "ritual", "cleric", "perso_arabic", "sanskritic")}
    return (
        F.when(c["nirgun"] & c["sagun_narrative"], "mixed_nirgun_sagun").when(c["nirgun"], "nirgun_leaning").when(c["sagun_narrative"], "sagun_narrative").when(c["ritual"] & c["cleric"], "critique_both").when(c["ritual"], "ritual_reference")
        .when(c["cleric"], "cleric_reference").when(c["perso_arabic"] & c["sanskritic"], "mixed_register").when(c["perso_arabic"], "perso_arabic_register").when(c["sanskritic"], "sanskritic_register").otherwise("unmarked")
    )


def distribution(tags: DataFrame, label: str = "primary_tag") -> DataFrame:
    """label, count, percent of all lines; a null tag is "unclassified"."""
    counts = tags.groupBy(F.coalesce(label, F.lit("unclassified")).alias("label")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(total)).select("label", "count", percent(F.col("count"), F.col("total")).alias("pct"))


def detailed_distribution(tags: DataFrame, label: str = "primary_tag", size: int = 100, unknown: str | None = "unknown") -> DataFrame:
    """level, grp, label, count and percent within the group: overall, by author, section and page range; ``unknown`` names the group without an author or section ("all" if it is None)."""
    base = tags.select(F.coalesce(label, F.lit("unclassified")).alias("label"), F.coalesce("author", F.lit(unknown)).alias("author"), F.coalesce("section", F.lit(unknown)).alias("section"), bucket(F.col("page"), size).alias("pages"))
    sets = base.groupingSets([["label"], ["label", "author"], ["label", "section"], ["label", "pages"]], "label", "author", "section", "pages").agg(F.count("*").alias("count"), F.grouping("author").alias("ga"), F.grouping("section").alias("gs"), F.grouping("pages").alias("gp"))
    level = F.when(F.col("ga") == 0, "author").when(F.col("gs") == 0, "section").when(F.col("gp") == 0, "pages").otherwise("overall")
    found = sets.select(level.alias("level"), F.coalesce("author", "section", "pages", F.lit("all")).alias("grp"), "label", "count")
    return found.withColumn("pct", percent(F.col("count"), F.sum("count").over(Window.partitionBy("level", "grp"))))  # over counts, not lines
