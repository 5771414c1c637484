import json
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from versicle import cli
from versicle.flow import Flow
from versicle.operators import bundle
from versicle.operators.lexicon import Lexicon
from versicle.operators.scoring import Dimension, Rule, Scoring, Thresholds
from versicle.runtime import Errors, FatalError, PhaseCache, map_partitions_by
from versicle.sources import files, html
from versicle.streaming.matcher import event_counts

PAGE = "<html><table><tr><td class='x'>ਰਾਗੁ ਆਸਾ ਮਹਲਾ ੫ ॥</td></tr><tr><td>ਹਰਿ &amp; ਨਾਮੁ ਹਰਿ ॥੧॥</td></tr><tr><td>page 1 of many</td></tr></table></html>"
LEXICON = Lexicon([{"id": "HARI", "canonical_form": "ਹਰਿ", "category": "divine_name", "tradition": "sikh", "register": "sanskritic", "aliases": [{"form": "ਹਰਿ"}]}, {"id": "NAAM", "canonical_form": "ਨਾਮੁ", "category": "concept", "tradition": "sikh", "register": "neutral", "aliases": [{"form": "ਨਾਮੁ"}]}])


def test_pages_to_bundle(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "ang_001.html").write_text(PAGE, encoding="utf-8")
    (pages / "ang_002.html").write_text("<html><font face='AnmolUniPr'><a>ਹਰਿ</a> <a>ਹਰਿ</a></font><td>ਨਾਮੁ ਨਾਮੁ</td></html>", encoding="utf-8")
    (pages / "ang_003.html").write_text("<html><p>none</p></html>", encoding="utf-8")
    (pages / "other.html").write_text(PAGE, encoding="utf-8")
    flow = Flow(spark, str(tmp_path / "out"), LEXICON, Scoring((Dimension("nirgun", (Rule(2.0, ("HARI",)),)),)), Thresholds())
    with pytest.raises(FileNotFoundError):
        flow.match()
    lines = flow.extract(str(pages))
    got = lines.orderBy("page", "line_number").select("page", "line_number", "author", "group_id", "text").collect()
    assert [r.text for r in got] == ["ਰਾਗੁ ਆਸਾ ਮਹਲਾ ੫", "ਹਰਿ & ਨਾਮੁ ਹਰਿ ੧", "ਹਰਿ ਹਰਿ"]
    assert [r.author for r in got] == ["M5", "M5", None] and got[0].group_id.endswith("-001") and got[2].group_id == "ang:2"
    report = json.loads((tmp_path / "out/validation_report.json").read_text())
    assert report["verdict"] == "PASS" and "PARSE_SELECTOR_FAIL" in (tmp_path / "out/corpus_errors.jsonl").read_text()
    assert flow.extract(str(pages)).count() == 3  # from the cache
    assert flow.match().count() == 5 and flow.features().count() == 3
    assert {r.primary_tag for r in flow.tag().collect()} == {None, "nirgun_leaning"}
    flow.reports(spark.createDataFrame([("S", "S", 1, 9, 0)], "id string, romanized string, page_start int, page_end int, ord int"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/reports/entity_counts")).count() == 2
    gold = tmp_path / "gold.jsonl"
    gold.write_text(json.dumps({"line_uid": lines.first().line_uid, "category": "x"}) + "\n\n", encoding="utf-8")
    assert flow.evaluate(str(gold)).count() >= 1
    assert flow.bundle() == []
    (tmp_path / "out/bundle/aggregates.json").write_text("{", encoding="utf-8")
    assert len(bundle.validate(str(tmp_path / "out/bundle"))) == 2
    assert bundle.validate(str(tmp_path / "nothing")) == ["manifest.json is missing"]


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.inside = [], False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.inside = True
            self.found.append("")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "a"

    def handle_data(self, data):
        if self.inside:
            self.found[-1] += data


def test_cells_equal_an_html_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page: [x for x in r.raws] for r in html.parse_lines(pages, "page_id", "html", "a", script=False).groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_number", "raw"))), lambda x: x["raw"]).alias("raws")).collect()}
    for r in pages.collect():
        parser = Links()
        parser.feed(r.html)
        assert got[r.page_id] == [" ".join(x.split()) for x in parser.found if len(" ".join(x.split())) > 2]
    assert html.paragraphs(pages).filter(F.col("text").contains("<")).count() == 0


def test_errors_and_cache(spark, tmp_path):
    errors = Errors("p", most=1)
    errors.add("WARNING", "W", "w")
    errors.add("ERROR", "E", "e", line_uid="1", extra=2)
    with pytest.raises(FatalError):
        errors.add("ERROR", "E", "again")
    with pytest.raises(FatalError):
        Errors("p").add("FATAL", "F", "f")
    with pytest.raises(ValueError):
        errors.add("odd", "x", "y")
    assert Errors("q").write(str(tmp_path)) is None and errors.write(str(tmp_path)).endswith("p_errors.jsonl")
    (tmp_path / "in").write_text("1")
    (tmp_path / "res").write_text("2")
    cache, paths = PhaseCache(str(tmp_path / "cache.json")), ([str(tmp_path / "in")], [str(tmp_path / "res")])
    assert not cache.hit("p", *paths)
    cache.update("p", *paths)
    assert cache.hit("p", *paths) and not cache.hit("p", *paths, force=True)
    (tmp_path / "in").write_text("3")
    assert not cache.hit("p", *paths)
    cache.update("p", *paths)
    cache.invalidate("p")
    assert not cache.hit("p", *paths)
    doubled = map_partitions_by(spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), "k", lambda d: d.assign(v=d.v * 2), "k int, v int")
    assert sorted(r.v for r in doubled.collect()) == [4, 6]


def test_cli(tmp_path, capsys):
    assert cli.phases("2,0,2") == [0, 2]
    assert cli.main(["run", "--phases", "0,9"]) == 1
    assert cli.main(["run", "--phases", "1,0", "--dry-run"]) == 0 and "0 1" in capsys.readouterr().out
    (tmp_path / "bad.yaml").write_text("entities: [{id: x}]\n")
    assert cli.main(["--lexicon", str(tmp_path / "bad.yaml"), "lint"]) == 1


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("1", "A", "a", None), ("2", "B", "b", "A")], "line_uid string, entity_id string, matched_form string, nested_in string")
    files.write_jsonl(df, str(tmp_path / "m"), ("line_uid",))
    got = files.read_matches(spark, str(tmp_path / "m")).orderBy("line_uid").collect()
    assert [(r.rule_id, r.confidence, r.nested_in) for r in got] == [("alias_exact", "HIGH", None), ("alias_exact", "HIGH", "A")]
    (tmp_path / "s.yaml").write_text("ragas: [{id: A, romanized: Aa, ang_start: 14, ang_end: 20}]\npreamble: {ang_start: 1, ang_end: 13}\n")
    assert [r.id for r in files.read_sections(spark, str(tmp_path / "s.yaml")).orderBy("ord").collect()] == ["A", "PREAMBLE"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "events")
    events.repartition(3).write.parquet(source)
    stream = event_counts(spark.readStream.schema(events.schema).parquet(source), late="3650 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, event_counts(events).collect()))
