"""The corpus of the query catalogue, and the same in SQL.

A document's lines are corpus lines, ten documents are a page, three a group; ``source`` is the
author. The lexicon is a handful of frequent words, with shared forms, nesting and crossing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features, matching
from ..operators.density import SECTION
from ..operators.lexicon import ALIAS, DIMENSIONS, ENTITY, Lexicon, dimensions_of
from ..operators.scoring import Dimension, Rule, Scoring, Thresholds

#: id, category, tradition, register, forms
ENTITIES = (
    ("ART_EN", "divine_name", "sikh", "neutral", ("the",)), ("ART_OTHER", "marker", "islamic", "perso_arabic", ("the",)), ("OF_EN", "concept", "yogic", "sanskritic", ("of",)),
    ("OF_THE", "narrative", "vaishnava", "sanskritic", ("of the",)), ("THE_IS", "practice", "vedantic", "neutral", ("the is",)), ("RITUAL_AND", "practice", "universal", "neutral", ("and",)),
    ("DE_LA", "ethical", "bhakti", "mixed", ("de la",)), ("DE", "devotional", "islamic", "perso_arabic", ("de",)), ("LA", "oneness", "universal", "neutral", ("la",)), ("DER", "scriptural", "vedantic", "sanskritic", ("der",)),
    ("QUE", "identity", None, "neutral", ("que",)), ("UND", "marker", "yogic", "perso_arabic", ("und",)), ("NEG_LE", "temporal", "islamic", None, ("le", "les")), ("IS", "divine_name", "universal", "sanskritic", ("is",)),
)
SECTIONS = (("S1", 1, 30), ("S2", 31, 60), ("S3", 61, 95), ("REST", 96, 20000), ("NONE", 20001, 20010))
#: As reports take them unless told otherwise: REST without an end, and the empty section where no page can be. The catalogue's queries follow the SQL, which has SECTIONS.
PLACED = tuple((i, *{"REST": (a, None), "NONE": (0, 0)}.get(i, (a, b))) for i, a, b in SECTIONS)
NEGATIONS = ("not", "no", "ne", "nicht", "un", "pas", "le")
SCORING = Scoring(
    (
        Dimension("nirgun", (Rule(1.0, ("ART_EN", "IS")), Rule(0.3, match_register="sanskritic"), Rule(0.8, has_negation_of_form=True))),
        Dimension("sagun_narrative", (Rule(1.0, ("OF_THE", "DE_LA")), Rule(0.0, match_register="perso_arabic"))),
        Dimension("critique_ritual", (Rule(0.5, ("RITUAL_AND", "THE_IS")), Rule(1.5, co_occurs_negation=True)), 2.5, 1.0),
        Dimension("universalism", (Rule(1.0, ("LA", "QUE")),)),
        Dimension("critique_clerics", (Rule(0.5, ("UND", "ART_OTHER")), Rule(1.5, co_occurs_negation=True)), 2.5, 1.0),
    )
)
VARIANTS = {"base": Thresholds(0.2, 0.3, 0.2, 0.15), "loose": Thresholds(0.1, 0.5, 0.1, 0.5), "strict": Thresholds(0.5, 0.1, 0.5, 0.1)}


def lexicon() -> Lexicon:
    return Lexicon([{"id": i, "canonical_form": f[0], "category": c, "tradition": t, "register": r, "polysemous": False, "source_file": "inline", "aliases": [{"form": x, "type": "exact"} for x in f]} for i, c, t, r, f in ENTITIES])


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(lexicon().aliases(), ALIAS)


def entities(spark: SparkSession) -> DataFrame:
    return lexicon().entity_frame(spark).select(*(x.split()[0] for x in ENTITY.split(", ")))


def bridge(spark: SparkSession) -> DataFrame:
    return dimensions_of(entities(spark))


def sections(spark: SparkSession, of: tuple = PLACED) -> DataFrame:
    return spark.createDataFrame([(i, i.title(), a, b, n) for n, (i, a, b) in enumerate(of)], SECTION)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.col("source").alias("author"), "lang", F.posexplode(F.split("text", "\n")).alias("line_number", "raw"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_uid, line_id, doc_id, page, line_number, author, lang, group_id, text, tokens, n_tokens."""
    # the filter asks for a character that stays: on "text" it would be pushed down and collapse every line twice
    found = raw_lines(spark, sf_dir).filter(F.col("raw").rlike("(?U)\\S")).withColumn("text", T.collapse(F.col("raw")))
    page = (F.floor(F.col("doc_id") / 10) + 1).cast("int")
    line_id = F.concat_ws(":", "doc_id", "line_number")
    found = found.select("doc_id", page.alias("page"), "line_number", "author", "lang", line_id.alias("line_id"), F.concat(F.lit("g"), F.floor(F.col("doc_id") / 3).cast("string")).alias("group_id"), "text", T.tokens(F.col("text")).alias("tokens"))
    return found.withColumns({"line_uid": T.line_uid(F.col("page"), F.col("line_id"), F.col("text")), "n_tokens": T.token_count(F.col("text"))})


MATCH_KEYS = ("line_uid", "page", "author", "group_id")


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with their matches: one scan, nothing shuffled."""
    return matching.matched(lines(spark, sf_dir), aliases(spark))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the matcher reads no tokens: column pruning leaves their expressions out of this plan
    return matching.exploded(matched(spark, sf_dir), MATCH_KEYS)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.line_counts(matched(spark, sf_dir), lexicon().by_dimension(), MATCH_KEYS)


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every line and dimension."""
    return features.unpivoted(wide(spark, sf_dir), ("line_uid", "page", "author", "group_id"))


def _values(rows: list[tuple]) -> str:
    text = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"


SQL_LINES = f"""
ali AS (SELECT * FROM {_values([(f, e, i, n) for f, e, _, i, n in lexicon().aliases()])} AS t(form, entity_id, alias_ord, n_words)),
ent AS (SELECT id, category, CAST(tradition AS VARCHAR) AS tradition, CAST(register AS VARCHAR) AS register FROM {_values([(i, c, t, r) for i, c, t, r, _ in ENTITIES])} AS t(id, category, tradition, register)),
bridge AS (
  SELECT id AS entity_id, register AS dim FROM ent WHERE register IN ('perso_arabic', 'sanskritic')
  UNION ALL SELECT id, CASE category WHEN 'narrative' THEN 'sagun_narrative' WHEN 'practice' THEN 'ritual' ELSE category END FROM ent WHERE category IN ('narrative', 'practice', 'ethical', 'devotional', 'oneness', 'scriptural', 'identity')
  UNION ALL SELECT id, 'cleric' FROM ent WHERE category = 'marker' AND tradition IN ('islamic', 'vedantic', 'yogic')
  UNION ALL SELECT id, 'nirgun' FROM ent WHERE (category = 'divine_name' AND tradition IN ('sikh', 'universal') AND register IN ('neutral', 'sanskritic')) OR (category = 'concept' AND tradition IN ('sikh', 'yogic'))),
sec AS (SELECT * FROM {_values([(i, a, b, n) for n, (i, a, b) in enumerate(SECTIONS)])} AS t(id, page_start, page_end, ord)),
dims AS (SELECT unnest([{", ".join(f"'{d}'" for d in DIMENSIONS)}]) AS dim),
raw AS (SELECT doc_id, source AS author, lang, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_number FROM documents),
ln0 AS (SELECT doc_id, CAST(doc_id // 10 + 1 AS INT) AS page, CAST(line_number AS INT) AS line_number, author, lang, doc_id || ':' || line_number AS line_id, 'g' || (doc_id // 3) AS group_id, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS text FROM raw),
ln AS (SELECT *, 'ang' || page || ':sha256:' || substr(sha256(page || ':' || line_id || ':' || text), 1, 12) AS line_uid,
  list_filter(list_transform(string_split(text, ' '), lambda x: regexp_replace(x, '^[।॥;,.\\-–—:!?()]+|[।॥;,.\\-–—:!?()]+$', '', 'g')), lambda x: x <> '') AS tokens FROM ln0 WHERE text <> ''),
lines AS (SELECT *, CAST(len(tokens) AS BIGINT) AS n_tokens FROM ln)"""

SQL_MATCHES = (
    SQL_LINES
    + """,
wd0 AS (SELECT line_uid, page, author, group_id, unnest(string_split(lower(text), ' ')) AS w, generate_subscripts(string_split(lower(text), ' '), 1) AS i FROM lines),
wd AS (SELECT *, lead(w) OVER v AS w2, coalesce(sum(length(w) + 1) OVER (PARTITION BY line_uid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM wd0 WINDOW v AS (PARTITION BY line_uid ORDER BY i)),
occ AS (SELECT line_uid, page, author, group_id, a.entity_id, a.form, a.alias_ord, CAST(g.start AS INT) AS start, CAST(g.start + length(a.form) AS INT) AS "end", count(*) OVER (PARTITION BY line_uid, g.start, a.form) > 1 AS shared
  FROM (SELECT line_uid, page, author, group_id, w AS form, start FROM wd UNION ALL SELECT line_uid, page, author, group_id, w || ' ' || w2, start FROM wd WHERE w2 IS NOT NULL) g JOIN ali a ON a.form = g.form),
kept AS (SELECT *, row_number() OVER (ORDER BY line_uid, start, -length(form), alias_ord) AS pos FROM occ m WHERE NOT EXISTS (SELECT 1 FROM occ k WHERE k.line_uid = m.line_uid AND k.start < m.start AND k."end" > m.start AND k."end" < m."end" AND length(m.form) <= length(k.form))),
nest AS (SELECT m.pos, arg_max(k.entity_id, k.pos) AS nested_in FROM kept m JOIN kept k ON k.line_uid = m.line_uid AND k.start <= m.start AND k."end" >= m."end" AND k.pos < m.pos GROUP BY m.pos),
matches AS (SELECT m.line_uid, m.page, m.author, m.group_id, m.entity_id, m.form, m.start, m."end", m.alias_ord, CASE WHEN m.shared THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, n.nested_in FROM kept m LEFT JOIN nest n ON n.pos = m.pos),
own AS (SELECT * FROM matches WHERE nested_in IS NULL),
cnt AS (SELECT line_uid, dim, count(*) AS c FROM own JOIN bridge USING (entity_id) GROUP BY ALL),
long AS (SELECT l.line_uid, l.page, l.author, l.group_id, l.n_tokens, d.dim, coalesce(c.c, 0) AS "count", CASE WHEN l.n_tokens = 0 THEN 0.0 ELSE round(coalesce(c.c, 0) / CAST(l.n_tokens AS DOUBLE), 6) END AS density FROM lines l CROSS JOIN dims d LEFT JOIN cnt c ON c.line_uid = l.line_uid AND c.dim = d.dim)"""
)
SQL_WIDE = SQL_MATCHES + ",\nwide AS (SELECT line_uid, page, author, group_id, n_tokens, " + ", ".join(f"CAST(sum(CASE WHEN dim = '{d}' THEN \"count\" ELSE 0 END) AS BIGINT) AS {d}" for d in DIMENSIONS) + " FROM long GROUP BY ALL)"
