import math

from pyspark.sql import functions as F

from versicle.operators import cooccurrence, corpus, density, evaluation, scoring, search, statistics


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_pairs(spark):
    windows = spark.createDataFrame([("1", "A"), ("1", "B"), ("2", "A"), ("2", "B"), ("3", "A"), ("4", "C")], "w string, entity_id string")
    got = cooccurrence.pairs(windows).first()
    assert (got.entity_a, got.entity_b, got.raw_count) == ("A", "B", 2) and got.pmi == round(math.log2(2 * 4 / (3 * 2)), 6) and got.jaccard == round(2 / 3, 6)
    assert got.npmi == round(math.log2(8 / 6) / 1.0, 6)
    assert cooccurrence.pairs(windows, min_support=3).first().pmi is None
    assert cooccurrence.pairs(windows, min_count=3).count() == 0
    kept = cooccurrence.pairs(windows, min_freq=2).first()  # C goes, and its window with it
    assert kept.pmi == round(math.log2(2 * 3 / (3 * 2)), 6)
    k = cooccurrence.pairs(windows, smoothing=0.5).first().pmi
    assert k == round(math.log2((2 + 0.5) * (4 + 0.5 * 9) / ((3 + 1.5) * (2 + 1.5))), 6)
    assert cooccurrence.pairs(windows.limit(0)).count() == 0


def test_sliding_and_sections(spark):
    long = spark.createDataFrame([(1, "d", 1.0), (1, "d", 0.0), (4, "d", 0.5)], "page int, dim string, density double")
    got = rows(density.sliding(long, 2), "window_start", "mean_density")
    assert got == [(1, 0.5), (2, 0.0), (3, 0.5)]
    sections = spark.createDataFrame([("S", "S", 1, 3, 0), ("T", "T", 3, 9, 1), ("E", "E", 20, 21, 2)], density.SECTION)
    assert rows(density.by_section(long, sections, ("d",)), "section", "lines", "mean", "median", "stdev") == [("E", 0, 0.0, 0.0, 0.0), ("S", 2, 0.5, 0.5, 0.707107), ("T", 1, 0.5, 0.5, 0.0)]


def test_scores_context_and_tags(spark):
    config = scoring.Scoring((scoring.Dimension("nirgun", (scoring.Rule(1.0, ("A",)), scoring.Rule(0.0, ("B",)))), scoring.Dimension("sagun_narrative", (scoring.Rule(1.0, ("B",)),))))
    schema = "line_uid string, group_id string, entity_ids array<string>, line_matches array<struct<start:int,alias_ord:int,entity_id:string,form:string>>, densities map<string,double>, has_negation boolean, ritual_negation boolean"
    ctx = spark.createDataFrame([("1", "g", ["A"], [(0, 0, "A", "aa")], {}, False, False), ("2", "g", [], [], {}, False, False), ("3", None, ["A", "B"], [], {}, False, False)], schema)
    got = {r.line_uid: r for r in scoring.tag(scoring.scores(ctx, config), config, scoring.Thresholds(nirgun_min=0.2)).collect()}
    assert got["1"].ctx_nirgun == 0.5 and got["3"].ctx_nirgun == 0.0 and math.isclose(got["1"].score_nirgun, 1 / (1 + math.exp(-2 * (0.8 + 0.1 - 1.5))))
    assert got["1"].primary_tag == "nirgun_leaning" and got["2"].primary_tag is None
    assert got["1"].evidence_tokens == ["aa"] and got["3"].rules_fired == ["match_entity:A", "match_entity:B"] and got["3"].evidence_tokens == ["A", "B"]
    assert [len(v) for v in got["3"].score_breakdown.values()] == [1, 1]
    parsed = scoring.Scoring.parse({"context_weight": 0.1, "dimensions": {"d": {"rules": [{"match_register": "x", "weight": 0.3}]}}})
    assert parsed.dimensions[0].rules[0].match_register == "x" and scoring.Thresholds.parse({"thresholds": {"mixed": {"both_min": 0.4}}}).mixed_both == 0.4


def test_evaluation(spark):
    gold = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", "b")], "line_uid string, category string")
    pred = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "line_uid string, primary_tag string")
    both = evaluation.joined(gold, pred)
    assert rows(both, "line_uid", "pred") == [("1", "a"), ("2", "b"), ("3", "unclassified"), ("4", "MISSING")]
    m = {r.category: r for r in evaluation.category_metrics(both).collect()}
    assert (m["a"].tp, m["a"].fp, m["a"].fn) == (1, 0, 1) and (m["b"].tp, m["b"].fp, m["b"].fn) == (0, 1, 2) and "MISSING" not in m
    macro = evaluation.macro(evaluation.category_metrics(both)).first()
    assert macro.macro_precision == 0.5 and macro.macro_recall == 0.25 and macro.macro_f1 == round(2 * 0.5 * 0.25 / 0.75, 6)
    assert evaluation.errors(both).count() == 3 and evaluation.report(evaluation.category_metrics(both)).count() == 4
    lines = spark.createDataFrame([(str(i), "x" if i < 90 else "y") for i in range(100)], "line_uid string, author string")
    picked = evaluation.proportional_sample(lines, 20).collect()
    assert len(picked) == 20 and {r.author for r in picked} == {"x", "y"} and len({r.line_uid for r in picked}) == 20
    pages = evaluation.page_sample(100, 10)
    assert len(pages) == 10 and all((i * 10 < p <= i * 10 + 10) for i, p in enumerate(pages))


def test_statistics(spark):
    values = spark.createDataFrame([("a", float(x)) for x in range(50)] + [("one", 3.0)] + [("none", None)], "g string, v double")
    got = {r.g: r for r in statistics.bootstrap_ci(values, "g", "v", samples=400).collect()}
    assert got["a"].mean == 24.5 and 18 < got["a"].ci_low < 22.5 and 26.5 < got["a"].ci_high < 31
    assert (got["one"].ci_low, got["one"].ci_high, got["none"].mean) == (3.0, 3.0, 0.0)
    again = {r.g: r for r in statistics.bootstrap_ci(values.repartition(7), "g", "v", samples=400).collect()}
    assert again == got
    d = statistics.cohens_d(values, "g", "v", "a", "one").first()
    assert d.d == 0.0 and d.effect == "negligible"


def test_forward_fill_compare_validate_search(spark):
    lines = spark.createDataFrame([(p, n, h) for p, n, h in [(1, 1, None), (1, 2, "x"), (2, 1, None), (3, 1, "y"), (3, 2, None)]], "page int, line_number int, h string")
    assert rows(corpus.forward_fill(lines, F.col("h"), "first"), "page", "line_number", "author") == [(1, 1, "first"), (1, 2, "x"), (2, 1, "x"), (3, 1, "y"), (3, 2, "y")]
    far = spark.createDataFrame([(None, 1, None), (None, 2, "n"), (5, 1, "a"), (20_000_000, 1, None), (20_000_001, 1, "b"), (2_000_000_000, 1, None)], "page int, line_number int, h string")
    assert {(r.page, r.line_number): r.author for r in corpus.forward_fill(far, F.col("h"), "first").collect()} == {(None, 1): "first", (None, 2): "n", (5, 1): "a", (20_000_000, 1): "a", (20_000_001, 1): "b", (2_000_000_000, 1): "b"}
    a = spark.createDataFrame([(1, i, t) for i, t in enumerate(["x y", "x, y", "ਕੰ", "ਕ਼", "x", "same", "only"])], "page int, line_index int, text string")
    b = spark.createDataFrame([(1, i, t) for i, t in enumerate(["x  y", "x y", "ਕਂ", "ਕ", "z", "same"])] + [(2, 0, "extra")], "page int, line_index int, text string")
    kinds = [r[0] for r in corpus.compare(a, b).orderBy("page", "line_index").select(F.coalesce("discrepancy", F.lit("match"))).collect()]
    assert kinds == ["whitespace_only", "vishram_only", "nasal_only", "nukta_only", "substantive", "match", "missing_line", "extra_line"]
    docs = spark.createDataFrame([("1", 1, ["a", "b", "a"]), ("2", 1, ["a"]), ("3", 2, [])], "line_uid string, page int, tokens array<string>")
    index = search.flat_postings(docs, "tokens")
    find = lambda q: [r.line_uid for r in search.search(index, docs, q, order=("page",)).collect()]
    assert find("a") == ["1", "2"] and find("b a") == ["1"] and find("") == [] and find("zz a") == []
    assert rows(search.postings(docs, "tokens", order=("page",), size=1), "term", "part", "n_docs") == [("a", 1, 2), ("b", 1, 1)]
