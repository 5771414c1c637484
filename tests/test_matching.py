import random

from pyspark.sql import functions as F

from versicle.operators import features, matching, scoring
from versicle.operators.lexicon import ALIAS, Lexicon, dimensions_of, lint, lint_files, problems_of


def brute(text, aliases):
    """Plain loop over all word runs, then overlap resolution in order."""
    words, at, found = text.split(" ") if text else [], 0, []
    starts = []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    for n in {len(f.split(" ")) for f, *_ in aliases}:
        for i in range(len(words) - n + 1):
            gram = " ".join(words[i : i + n])
            found += [(starts[i], -len(gram), o, starts[i] + len(gram), e) for f, e, _, o, _ in aliases if f == gram]
    kept = []
    for s, neg, o, end, e in sorted(found):
        nested, lost = None, False
        for ks, kend, ke, _ in kept:
            if s < kend and end > ks:
                if ks <= s and kend >= end:
                    nested = ke
                elif not (s <= ks and end >= kend) and end - s <= kend - ks:
                    lost = True
                    break
        if not lost:
            kept.append((s, end, e, nested))
    return sorted(kept, key=str)


FORMS = [("a", "A"), ("b", "B"), ("a b", "AB"), ("b c", "BC"), ("b c d", "BCD"), ("a", "A2"), ("c d a b", "LONG")]
ALIASES = [(f, e, "exact", i, len(f.split(" "))) for i, (f, e) in enumerate(FORMS)]


def test_matches_equal_a_plain_loop(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdx") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    lines = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("null", None)], "line_uid string, text string")
    got = {}
    for r in matching.match(lines, spark.createDataFrame(ALIASES, ALIAS)).collect():
        got.setdefault(r.line_uid, []).append((r.start, r.end, r.entity_id, r.nested_in))
    for i, t in enumerate(texts):
        assert sorted(got.get(str(i), []), key=str) == brute(t, ALIASES), t
    assert "null" not in got


def test_large_dictionary_and_arrays(spark, monkeypatch):
    """A dictionary too large to send is joined; counts and contexts from arrays equal those from tables."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdx") for _ in range(rng.randint(0, 14))) for _ in range(120)]
    lines = spark.createDataFrame([(str(i), t, len(t.split())) for i, t in enumerate(texts)] + [("null", None, 0)], "line_uid string, text string, n_tokens int")
    table = spark.createDataFrame(ALIASES, ALIAS)
    both = []
    for most in (1_000_000, 3):
        monkeypatch.setattr(matching, "BROADCAST_ALIASES", most)
        for strict in (False, True):
            both.append(sorted((tuple(r) for r in matching.match(lines, table, strict_longest=strict).collect()), key=str))
        both.append(sorted((tuple(r) for r in matching.occurrences(lines.select("line_uid", "text"), table).collect()), key=str))
    assert both[:3] == both[3:] and len(both[0]) > 100
    monkeypatch.setattr(matching, "BROADCAST_ALIASES", 1_000_000)
    kinds = {"A": ("concept", "sikh", "sanskritic"), "AB": ("marker", "islamic", None), "BC": ("practice", None, "perso_arabic"), "BCD": ("divine_name", "sikh", "neutral")}
    lexicon = Lexicon([{"id": e, "canonical_form": f, "category": kinds.get(e, ("place", None, None))[0], "tradition": kinds.get(e, (0, None))[1], "register": kinds.get(e, (0, 0, None))[2], "aliases": [{"form": f}]} for f, e in FORMS])
    with_matches, matches = matching.matched(lines, table), matching.match(lines, table)
    wide = features.wide_features(lines, matches, lexicon.dimension_frame(spark))
    counts = features.line_counts(with_matches, lexicon.by_dimension())
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, counts.select(*wide.columns).collect()))
    long = features.unpivoted(wide, ("line_uid",)).filter("count > 0")
    want = {r.line_uid: r for r in scoring.contexts(lines, matches, long, ("B",), ("A",)).collect()}
    got = {r.line_uid: r for r in scoring.line_contexts(with_matches, lexicon.by_dimension(), ("B",), ("A",)).collect()}
    for k, r in want.items():
        assert (sorted(r.entity_ids), r.line_matches, r.densities, r.has_negation, r.ritual_negation) == (sorted(got[k].entity_ids), got[k].line_matches, got[k].densities, got[k].has_negation, got[k].ritual_negation)


def test_long_lines_take_linear_time(spark):
    import time

    from versicle.functions import text as T

    line = "a b c x " * 25_000
    df = spark.createDataFrame([("1", line.strip())], "line_uid string, text string")
    table = spark.createDataFrame(ALIASES, ALIAS)
    assert matching.match(df.limit(0), table).count() == 0  # workers are up
    began = time.time()
    assert matching.match(df, table).count() >= 100_000
    assert df.select(F.size(T.token_spans(F.col("text"), F.split("text", " "))).alias("n")).first().n == 100_000
    assert time.time() - began < 10


def test_confidence_case_and_strict(spark):
    lines = spark.createDataFrame([("1", "A b c d")], "line_uid string, text string")
    table = spark.createDataFrame(ALIASES, ALIAS)
    got = {(r.form, r.entity_id): r.confidence for r in matching.match(lines, table, polysemous=("B",)).collect()}
    assert got["a", "A"] == got["a", "A2"] == "MEDIUM" and got["b", "B"] == "MEDIUM" and got["a b", "AB"] == "HIGH"
    assert {r.form for r in matching.match(lines, table, case_fold=False).collect()} == {"b", "b c", "b c d"}
    strict = {r.form for r in matching.match(lines, table, strict_longest=True).collect()}
    assert "b c d" in strict and "a b" not in strict


def test_features_count_once_per_dimension(spark):
    lexicon = Lexicon([{"id": "A", "canonical_form": "a", "category": "divine_name", "tradition": "sikh", "register": "sanskritic", "aliases": [{"form": "a"}]}, {"id": "B", "canonical_form": "b", "category": "place", "tradition": None, "register": None, "aliases": [{"form": "b"}]}])
    lines = spark.createDataFrame([("1", "a a b", 3), ("2", "x", 0)], "line_uid string, text string, n_tokens long")
    m = matching.match(lines, lexicon.alias_frame(spark))
    bridge = lexicon.dimension_frame(spark)
    assert sorted(tuple(r) for r in bridge.collect()) == [("A", "nirgun"), ("A", "sanskritic")]
    long = {(r.line_uid, r.dim): (r["count"], r.density, r.forms) for r in features.long_features(lines, m, bridge).collect()}
    assert long == {("1", "nirgun"): (2, 0.666667, ["a", "a"]), ("1", "sanskritic"): (2, 0.666667, ["a", "a"])}
    wide = {r.line_uid: r.nirgun for r in features.wide_features(lines, m, bridge).collect()}
    assert wide == {"1": 2, "2": 0}


def test_lexicon_checks(spark, tmp_path):
    import pytest
    from versicle.operators.lexicon import LexiconError, load_lexicon

    good = "entities:\n- {id: GOOD, canonical_form: x, category: concept, tradition: sikh, register: neutral, aliases: [{form: ' x  y ', type: exact}]}\n"
    (tmp_path / "a.yaml").write_text(good)
    (tmp_path / "b.yaml").write_text("other: 1\n")
    lexicon = load_lexicon(["a.yaml", "b.yaml", "none.yaml"], str(tmp_path))
    assert lexicon.aliases() == [("x y", "GOOD", "exact", 0, 2)] and list(lexicon.hashes) == ["a.yaml"] and lexicon.by_form() == {"x y": ["GOOD"]}
    with pytest.raises(LexiconError):
        load_lexicon(["a.yaml", "a.yaml"], str(tmp_path))
    assert len(problems_of({"id": "bad", "category": "none", "aliases": [{"form": "x", "type": "odd"}, {}]})) == 5
    found = lint(spark.createDataFrame([("x", "A", "exact", 0, 1), ("X", "B", "exact", 1, 1), ("x", "C", "exact", 2, 1)], ALIAS), spark.createDataFrame([("A", "a", "concept", None, None, None, False, ""), ("lower", "", "odd", None, None, None, False, "")], "id string, canonical_form string, category string, tradition string, register string, notes string, polysemous boolean, source_file string"))
    got = {(r.check, r.severity, r.subject) for r in found.collect()}
    assert got == {("duplicate_alias", "WARNING", "x"), ("normalization_collision", "WARNING", "x"), ("id_pattern", "ERROR", "lower"), ("controlled_vocab", "ERROR", "lower"), ("required_fields", "ERROR", "lower"), ("schema_conformance", "ERROR", "lower"), *(("alias_coverage", "WARNING", e) for e in "ABC")}
    (tmp_path / "c.yaml").write_text("entities: [{id: A, aliases: [}")
    assert [x["check"] for x in lint_files(["a.yaml", "b.yaml", "c.yaml"], str(tmp_path))] == ["yaml_valid"]
    assert dimensions_of(spark.createDataFrame([("Z", "cat", None, None)], "id string, category string, tradition string, register string")).count() == 0
    assert F is not None
