"""Phase drivers: pages to lines, lines to matches, features, tags, reports and the bundle."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import bundle, cooccurrence, corpus, density, evaluation, features, matching, reports, search
from .operators import scoring as rules
from .operators.lexicon import DIMENSIONS, Lexicon
from .runtime import Errors, Manifest, PhaseCache
from .sources import files, html

KEYS = ("line_uid", "page", "author", "group_id")


@dataclass
class Flow:
    """One corpus run in a folder. Each phase's table is written as Parquet once and read by the next."""

    spark: SparkSession
    folder: str
    lexicon: Lexicon
    scoring: rules.Scoring = field(default_factory=lambda: rules.Scoring(()))
    thresholds: rules.Thresholds = field(default_factory=rules.Thresholds)
    policy: T.Normalization = field(default_factory=T.Normalization)
    force: bool = False

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.table(name)

    def _need(self, *names: str) -> None:
        missing = [n for n in names if not Path(self.folder, n).exists()]
        if missing:
            raise FileNotFoundError(f"run the earlier phases first: {', '.join(missing)} missing in {self.folder}")

    def extract(self, pages_dir: str, first: int | None = None, last: int | None = None, script: bool = True) -> DataFrame:
        """Phase 0: pages to canonical lines, with a validation report and a manifest; page errors are recorded, not fatal."""
        cache, errors, manifest = PhaseCache(f"{self.folder}/cache.json"), Errors("corpus"), Manifest("corpus")
        if cache.hit("corpus", [pages_dir], [f"{self.folder}/lines"], self.force):
            return self.table("lines")
        raw = html.parse_lines(html.scan_directory(self.spark, pages_dir, first, last), script=script)
        errors.take(raw.filter("error is not null"), "PARSE_SELECTOR_FAIL", "page")
        made = html.canonical(html.structure(raw), self.policy).filter("text <> ''")
        made = made.withColumns({"group_id": F.coalesce("group_id", F.concat(F.lit("ang:"), F.col("page").cast("string"))), "n_tokens": F.size("tokens").cast("long")})
        lines = self._write("lines", made)
        checks = corpus.validate(lines, T.normalize(F.col("text"), self.policy)).collect()
        files.write_document({"verdict": "PASS" if all(r["passed"] for r in checks) else "FAIL", "checks": [r.asDict() for r in checks]}, f"{self.folder}/validation_report.json")
        if not all(r["passed"] for r in checks if r["check"] == "unique_line_uid"):
            errors.add("FATAL", "DUPLICATE_LINE_UID", "line ids repeat")
        manifest.counts = {"lines": lines.count(), "page_errors": errors.count("ERROR")}
        manifest.write(f"{self.folder}/run_manifest.json")
        errors.write(self.folder)
        cache.update("corpus", [pages_dir], [f"{self.folder}/lines"])
        return lines

    def match(self) -> DataFrame:
        """Phase 1."""
        self._need("lines")
        shared = tuple(e["id"] for e in self.lexicon.entities if e.get("polysemous"))
        return self._write("matches", matching.match(self.table("lines"), self.lexicon.alias_frame(self.spark), "text", KEYS, shared, case_fold=False))

    def features(self) -> DataFrame:
        """Phase 2: counts by dimension, wide; their densities in long form are derived where needed."""
        self._need("lines", "matches")
        return self._write("features", features.wide_features(self.table("lines"), self.table("matches"), self.lexicon.dimension_frame(self.spark), ("line_uid",), KEYS[1:]))

    def long(self) -> DataFrame:
        return features.unpivoted(self.table("features"), KEYS)

    def tag(self) -> DataFrame:
        """Phase 3."""
        self._need("lines", "matches", "features")
        context = rules.contexts(self.table("lines"), self.table("matches"), self.long().filter("count > 0"), keep=KEYS[1:])
        found = rules.tag(rules.scores(context, self.scoring), self.scoring, self.thresholds)
        return self._write("tags", found.drop("line_matches", "densities"))

    def reports(self, sections: DataFrame) -> None:
        """CSV and JSON reports: counts, densities, co-occurrence, tag distributions."""
        lines, matches, entities = self.table("lines"), self.table("matches"), self.lexicon.entity_frame(self.spark)
        out = f"{self.folder}/reports"
        files.write_csv(reports.entity_counts(matches, lines, entities), f"{out}/entity_counts", ("entity_id",))
        files.write_csv(reports.by_bucket(matches), f"{out}/entity_counts_by_bucket", ("entity_id", "bucket"))
        files.write_csv(reports.by_section(matches, sections), f"{out}/entity_counts_by_section", ("entity_id", "section"))
        files.write_csv(density.by_page(self.long()), f"{out}/page_density", ("page", "dim"))
        files.write_csv(density.by_section(self.long(), sections, DIMENSIONS), f"{out}/section_density", ("section", "dim"))
        files.write_csv(density.sliding(self.long()), f"{out}/window_density", ("dim", "window_start"))
        pairs = cooccurrence.levels(matches, {"line": "line_uid", "shabad": "group_id"})
        files.write_csv(pairs, f"{out}/cooccurrence", ("window_level", "entity_a", "entity_b"))
        files.write_csv(cooccurrence.cross_group(cooccurrence.pairs(cooccurrence.window_entities(matches, "line_uid")), entities), f"{out}/cross_tradition")
        if Path(self.folder, "tags").exists():
            files.write_csv(rules.distribution(self.table("tags")), f"{out}/tag_distribution", ("label",))

    def evaluate(self, gold_path: str) -> DataFrame:
        self._need("tags")
        both = evaluation.joined(files.read_gold(self.spark, gold_path), self.table("tags"))
        metrics = evaluation.category_metrics(both)
        files.write_csv(evaluation.report(metrics), f"{self.folder}/evaluation/metrics", ("category",))
        files.write_jsonl(evaluation.errors(both), f"{self.folder}/evaluation/errors", ("line_uid",))
        files.write_document([r.asDict() for r in evaluation.confusion(both).orderBy("gold", "pred").collect()], f"{self.folder}/evaluation/confusion.json")
        return metrics

    def bundle(self) -> list[str]:
        """Chunks, search index, aggregates, lineage and manifest; returns the problems that validation finds."""
        self._need("lines", "matches", "features")
        out = f"{self.folder}/bundle"
        tags = self.table("tags") if Path(self.folder, "tags").exists() else None
        lines, matches = self.table("lines"), self.table("matches")
        files.write_chunks(bundle.chunks(bundle.joined(lines, matches, self.long().filter("count > 0"), tags)), f"{out}/chunks")
        docs = search.documents(lines, matches, keep=("page", "line_number", "author", "text", "tokens"))
        files.write_jsonl(docs.drop("tokens"), f"{out}/search/documents", ("page", "line_number"))
        files.write_jsonl(search.postings(docs, "tokens"), f"{out}/search/tokens", ("term",))
        files.write_jsonl(search.postings(docs, "entities"), f"{out}/search/entities", ("term",))
        stats = reports.corpus_stats(lines).first().asDict() | reports.match_stats(matches).first().asDict()
        files.write_document(stats, f"{out}/aggregates.json")
        steps = [("corpus", ["pages"], ["lines"], {"steps": self.policy.steps()}), ("match", ["lines", "lexicon"], ["matches"], {}), ("features", ["lines", "matches"], ["features"], {}), ("tags", ["lines", "matches", "features"], ["tags"], {})]
        files.write_document(bundle.lineage(steps), f"{out}/lineage.json")
        bundle.write_manifest(out, {k: stats[k] for k in ("lines", "tokens", "matches")}, self.lexicon.hashes)
        return bundle.validate(out)
