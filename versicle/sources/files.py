"""JSON lines, CSV and YAML in and out."""

from __future__ import annotations

import json
import os
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "schema_version string, ang int, line_id string, line_uid string, gurmukhi_raw string, gurmukhi string, tokens array<string>, token_spans array<array<int>>, meta struct<raga:string,author:string,shabad_id:string,shabad_uid:string,rahao:boolean,pauri:int,structural_markers:array<string>>, source_ang_url string"
MATCH = "line_uid string, entity_id string, matched_form string, span array<int>, rule_id string, confidence string, ambiguity struct<alternative_entities:array<string>,disambiguation_rule:string>, nested_in string"
FEATURE = "line_uid string, shabad_uid string, token_count int, features map<string,struct<count:int,density:double,matched_tokens:array<string>>>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file with a given schema; blank lines are skipped, absent fields are null."""
    return spark.read.schema(schema).json(path).dropna("all")


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    found = read_jsonl(spark, path, MATCH)
    return found.withColumns({"rule_id": F.coalesce("rule_id", F.lit("alias_exact")), "confidence": F.coalesce("confidence", F.lit("HIGH"))})


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold labels; fails where the file is missing."""
    from ..operators.evaluation import GOLD

    return read_jsonl(spark, path, GOLD)


def write_jsonl(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """JSON lines in the given order; range-partitioned, so that parts in name order are in order."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def write_chunks(df: DataFrame, path: str, chunk_col: str = "chunk") -> None:
    """One folder of JSON per page-range chunk."""
    df.repartition(chunk_col).write.mode("overwrite").partitionBy(chunk_col).json(path)


def write_document(value: object, path: str) -> None:
    """A small result as one JSON document, written whole or not at all."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    temporary = f"{path}.part"
    Path(temporary).write_text(json.dumps(value, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    os.replace(temporary, path)


def read_yaml(path: str) -> dict:
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Sections of a YAML file, in order, with the pages before and after as sections of their own."""
    from ..operators.density import SECTION

    data = read_yaml(path)
    listed = data.get("ragas") or data.get("sections") or []
    rows = [(s["id"], s.get("romanized") or s["id"], int(s["ang_start"]), int(s["ang_end"])) for s in listed]
    for key, name in (("preamble", "PREAMBLE"), ("epilogue", "EPILOGUE")):
        if data.get(key):
            rows.append((name, name.title(), int(data[key]["ang_start"]), int(data[key]["ang_end"])))
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SECTION)
