"""Lexicon: entities, aliases, dimensions and checks."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import reduce

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_script, normalize

# Controlled vocabularies and the order of the feature dimensions.
CATEGORIES = ("divine_name", "concept", "narrative", "practice", "ethical", "devotional", "oneness", "scriptural", "identity", "marker", "place", "person", "temporal")
TRADITIONS = ("sikh", "islamic", "vedantic", "vaishnava", "yogic", "bhakti", "universal")
REGISTERS = ("perso_arabic", "sanskritic", "neutral", "mixed")
ALIAS_TYPES = ("exact", "prefix", "suffix")
DIMENSIONS = ("perso_arabic", "sanskritic", "nirgun", "sagun_narrative", "ritual", "cleric", "ethical", "devotional", "oneness", "scriptural", "identity")
BY_CATEGORY = {"narrative": "sagun_narrative", "practice": "ritual", "ethical": "ethical", "devotional": "devotional", "oneness": "oneness", "scriptural": "scriptural", "identity": "identity"}

ENTITY = "id string, canonical_form string, category string, tradition string, register string, notes string, polysemous boolean, source_file string"
ALIAS = "form string, entity_id string, type string, alias_ord int, n_words int"


class LexiconError(ValueError):
    """All problems of a lexicon at once."""


@dataclass
class Lexicon:
    """Entities in load order, as dictionaries with the fields of ENTITY and their aliases."""

    entities: list[dict] = field(default_factory=list)
    hashes: dict[str, str] = field(default_factory=dict)

    def aliases(self) -> list[tuple]:
        """(form, entity, type, ordinal, words) in load order; forms trimmed and single-spaced."""
        found = [(" ".join(a["form"].split()), e["id"], a.get("type", "exact")) for e in self.entities for a in e["aliases"]]
        return [(form, entity, kind, i, len(form.split(" "))) for i, (form, entity, kind) in enumerate(found)]

    def entity_frame(self, spark: SparkSession) -> DataFrame:
        names = [x.split()[0] for x in ENTITY.split(", ")]
        return spark.createDataFrame([tuple(e.get(n) for n in names) for e in self.entities], ENTITY)

    def alias_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.aliases(), ALIAS)

    def by_form(self) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for form, entity, *_ in self.aliases():
            found.setdefault(form, []).append(entity)
        return found

    def by_dimension(self) -> dict[str, tuple[str, ...]]:
        """The entities of each dimension, as ``dimensions_of`` has them."""
        found: dict[str, tuple[str, ...]] = {d: () for d in DIMENSIONS}
        for e in self.entities:
            for d in entity_dimensions(e["category"], e.get("tradition"), e.get("register")):
                found[d] += (e["id"],)
        return found

    def dimension_frame(self, spark: SparkSession) -> DataFrame:
        """(entity_id, dim): the bridge that every feature aggregate joins with."""
        return dimensions_of(self.entity_frame(spark))


def load_lexicon(paths: list[str], base_dir: str = ".") -> Lexicon:
    """The lexicon of several YAML files, in order; missing files and those without ``entities`` are skipped.

    Raises LexiconError with every invalid entity, or on an id that occurs twice.
    """
    from pathlib import Path

    lexicon, problems, seen = Lexicon(), [], {}
    for name in paths:
        path = Path(base_dir, name)
        if not path.exists():
            continue
        raw = path.read_bytes()
        data = yaml.safe_load(raw)
        if not isinstance(data, dict) or "entities" not in data:
            continue
        lexicon.hashes[str(name)] = hashlib.sha256(raw).hexdigest()
        for entity in data["entities"]:
            found = problems_of(entity)
            problems += [f"{name}: {x}" for x in found]
            if not found and entity["id"] in seen:
                problems.append(f"{name}: {entity['id']} is also in {seen[entity['id']]}")
            if not found:
                seen[entity["id"]] = name
                lexicon.entities.append({"polysemous": False, **entity, "source_file": str(name)})
    if problems:
        raise LexiconError("\n".join(problems))
    return lexicon


def problems_of(entity: object) -> list[str]:
    """What is wrong with one entity: fields, id pattern, vocabularies, aliases."""
    if not isinstance(entity, dict):
        return ["an entity must be a mapping"]
    found = [f"{entity.get('id', '?')}: {name} is missing" for name in ("id", "canonical_form", "category", "aliases") if not entity.get(name)]
    if entity.get("id") and not re.fullmatch(r"[A-Z][A-Z0-9_]*", str(entity["id"])):
        found.append(f"{entity['id']}: an id has capitals, digits and underscores")
    for name, allowed in (("category", CATEGORIES), ("tradition", TRADITIONS), ("register", REGISTERS)):
        if entity.get(name) and entity[name] not in allowed:
            found.append(f"{entity.get('id', '?')}: {name} {entity[name]!r} is unknown")
    for alias in entity.get("aliases") or []:
        if not isinstance(alias, dict) or not alias.get("form"):
            found.append(f"{entity.get('id', '?')}: an alias needs a form")
        elif alias.get("type", "exact") not in ALIAS_TYPES:
            found.append(f"{entity.get('id', '?')}: alias type {alias['type']!r} is unknown")
    return found


def entity_dimensions(category: str | None, tradition: str | None, register: str | None) -> list[str]:
    """The dimensions an entity counts for; some count for several, some for none."""
    found = [register] if register in ("perso_arabic", "sanskritic") else []
    if category in BY_CATEGORY:
        found.append(BY_CATEGORY[category])
    if category == "marker" and tradition in ("islamic", "vedantic", "yogic"):
        found.append("cleric")
    if category == "divine_name" and tradition in ("sikh", "universal") and register in ("neutral", "sanskritic") or category == "concept" and tradition in ("sikh", "yogic"):
        found.append("nirgun")
    return found


def dimensions_of(entities: DataFrame) -> DataFrame:
    """(entity_id, dim) of every dimension an entity counts for; some count for several, some for none."""
    register, category, tradition = F.col("register"), F.col("category"), F.col("tradition")
    by_category: Column = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, dim in BY_CATEGORY.items():
        by_category = by_category.when(category == name, dim)
    by_category = by_category.when((category == "marker") & tradition.isin("islamic", "vedantic", "yogic"), "cleric")
    formless = ((category == "divine_name") & tradition.isin("sikh", "universal") & register.isin("neutral", "sanskritic")) | ((category == "concept") & tradition.isin("sikh", "yogic"))
    dims = F.array_compact(F.array(F.when(register.isin("perso_arabic", "sanskritic"), register), by_category, F.when(formless, "nirgun")))
    return entities.select(F.col("id").alias("entity_id"), F.explode(dims).alias("dim"))


def lint(aliases: DataFrame, entities: DataFrame, normalized: Column | None = None) -> DataFrame:
    """(check, severity, subject, detail) of every issue of a lexicon.

    Errors: ids that repeat or break the pattern, fields that are missing, words outside the
    vocabularies, aliases without form or type, entities without alias. Warnings: a form without a
    letter of the script, a form that another entity has too, forms of different entities that are
    alike once normalised (by ``normalize``, if no other normal form is given).
    """
    norm = normalize(F.col("form")) if normalized is None else normalized

    def one(check: str, df: DataFrame, subject: Column, detail: Column, severity: str = "ERROR") -> DataFrame:
        return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))

    def several(keys: Column, name: str, who: str) -> DataFrame:
        found = aliases.filter(keys.isNotNull()).groupBy(keys.alias(name)).agg(F.array_join(F.array_sort(F.collect_set(who)), ",").alias("all"), F.countDistinct("entity_id").alias("n"))
        return found.filter("n > 1")

    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    parts = [
        one("unique_ids", entities.filter(~blank("id")).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), F.col("id"), F.col("n")),
        one("id_pattern", entities.filter(~blank("id") & ~F.col("id").rlike("^[A-Z][A-Z0-9_]*$")), F.col("id"), F.lit("")),
        *(one("required_fields", entities.filter(blank(c)), F.col("id"), F.lit(c)) for c in ("id", "canonical_form", "category")),
        *(one("controlled_vocab", entities.filter(F.col(c).isNotNull() & ~F.col(c).isin(*allowed)), F.col("id"), F.col(c)) for c, allowed in (("category", CATEGORIES), ("tradition", TRADITIONS), ("register", REGISTERS))),
        one("controlled_vocab", aliases.filter(F.col("type").isNotNull() & ~F.col("type").isin(*ALIAS_TYPES)), F.col("entity_id"), F.col("type")),
        one("schema_conformance", aliases.filter(blank("form") | F.col("type").isNull()), F.col("entity_id"), F.lit("an alias needs form and type")),
        one("schema_conformance", entities.join(aliases, entities["id"] == aliases["entity_id"], "left_anti"), F.col("id"), F.lit("no alias")),
        one("alias_coverage", aliases.filter(~blank("form") & ~has_script(F.col("form"))), F.col("entity_id"), F.col("form"), "WARNING"),
        one("duplicate_alias", several(F.col("form"), "form_", "entity_id"), F.col("form_"), F.col("all"), "WARNING"),
        one("normalization_collision", several(norm, "norm", "form"), F.col("norm"), F.col("all"), "WARNING"),
    ]
    return reduce(DataFrame.unionByName, parts)


def lint_files(paths: list[str], base_dir: str = ".") -> list[dict]:
    """yaml_valid and the other issues of single files that ``lint`` cannot see, as (check, severity, subject, detail) dictionaries."""
    from pathlib import Path

    found = []
    for name in paths:
        try:
            data = yaml.safe_load(Path(base_dir, name).read_bytes())
        except (OSError, yaml.YAMLError) as problem:
            found.append({"check": "yaml_valid", "severity": "ERROR", "subject": str(name), "detail": str(problem)})
            continue
        for entity in (data.get("entities") or []) if isinstance(data, dict) else []:
            for text in problems_of(entity):
                found.append({"check": "schema_conformance", "severity": "ERROR", "subject": str(name), "detail": text})
    return found
