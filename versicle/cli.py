"""Command line: corpus, analysis and bundle phases, lexicon lint."""

from __future__ import annotations

import argparse
import sys

from . import __version__
from .flow import Flow
from .operators.lexicon import Lexicon, LexiconError, lint, load_lexicon
from .operators.scoring import Scoring, Thresholds
from .runtime import session
from .sources.files import read_sections, read_yaml


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="versicle", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--folder", default="out", help="where a run's tables and reports are kept")
    p.add_argument("--lexicon", action="append", default=[], help="a lexicon YAML file; may be repeated, in order")
    p.add_argument("--config", help="configuration YAML with a tagging part")
    p.add_argument("--force", action="store_true", help="run phases that are up to date too")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="phases 0 to 3, such as 0,1,2,3")
    run.add_argument("--phases", default="0,1,2,3")
    run.add_argument("--pages", help="folder of HTML pages, for phase 0")
    run.add_argument("--first", type=int)
    run.add_argument("--last", type=int)
    run.add_argument("--dry-run", action="store_true")
    report = sub.add_parser("report", help="CSV reports")
    report.add_argument("--sections", required=True)
    evaluate = sub.add_parser("evaluate", help="metrics against gold labels")
    evaluate.add_argument("gold")
    sub.add_parser("bundle", help="publishable bundle")
    sub.add_parser("lint", help="check the lexicon")
    return p


def phases(text: str) -> list[int]:
    """Phase numbers in order, each once."""
    found = sorted({int(x) for x in text.split(",") if x.strip()})
    if any(x not in range(4) for x in found):
        raise ValueError("phases are 0 to 3")
    return found


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        lexicon = load_lexicon(args.lexicon) if args.lexicon else Lexicon()
        wanted = phases(args.phases) if args.command == "run" else []
    except (LexiconError, ValueError) as problem:
        print(problem, file=sys.stderr)
        return 1
    if args.command == "run" and args.dry_run:
        print("phases:", *wanted)
        return 0
    config = read_yaml(args.config).get("tagging", {}) if args.config else {}
    spark = session()
    flow = Flow(spark, args.folder, lexicon, Scoring.parse(config), Thresholds.parse(config), force=args.force)
    if args.command == "lint":
        issues = lint(lexicon.alias_frame(spark), lexicon.entity_frame(spark)).orderBy("check", "subject").collect()
        for r in issues:
            print(r["check"], r["subject"], r["detail"])
        return int(bool(issues))
    if args.command == "bundle":
        problems = flow.bundle()
        print(*(problems or ["the bundle is sound"]), sep="\n")
        return int(bool(problems))
    if args.command == "report":
        flow.reports(read_sections(spark, args.sections))
        return 0
    if args.command == "evaluate":
        flow.evaluate(args.gold).orderBy("category").show(100, False)
        return 0
    for phase in wanted:
        try:
            {0: lambda: flow.extract(args.pages, args.first, args.last), 1: flow.match, 2: flow.features, 3: flow.tag}[phase]()
        except (FileNotFoundError, TypeError) as problem:
            print(f"phase {phase}: {problem}", file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
