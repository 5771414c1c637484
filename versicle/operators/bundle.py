"""The published bundle: joined records in chunks, aggregates, manifest, lineage, validation."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk
from ..sources.files import write_document


def joined(lines: DataFrame, matches: DataFrame, long: DataFrame | None = None, tags: DataFrame | None = None, key: str = "line_uid") -> DataFrame:
    """Lines with their matches, features and tags; what a line lacks is empty, not null."""
    m = matches.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "entity_id", "form", "nested_in"))).alias("__m"))
    found = lines.join(m, key, "left").withColumn("matches", F.coalesce("__m", F.array().cast(m.schema["__m"].dataType))).drop("__m")
    if long is not None:
        f = long.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim", F.struct("count", "density")))).alias("__f"))
        found = found.join(f, key, "left").withColumn("features", F.coalesce("__f", F.create_map().cast(f.schema["__f"].dataType))).drop("__f")
    if tags is not None:
        found = found.join(tags.select(key, "primary_tag", "secondary_tags"), key, "left")
    return found


def chunks(records: DataFrame, size: int = 50, places: int | None = None) -> DataFrame:
    """``records`` with their page-range chunk; written with one folder per chunk, never gathered in one row."""
    return records.withColumn("chunk", chunk(F.col("page"), size, places))


def chunk_totals(records: DataFrame, size: int = 50, places: int | None = None) -> DataFrame:
    return chunks(records, size, places).groupBy("chunk").agg(F.count("*").alias("lines"), F.sum(F.size("matches")).alias("matches"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def sha256_of(path: str) -> str:
    digest = hashlib.sha256()
    with Path(path).open("rb") as f:
        for part in iter(lambda: f.read(1 << 20), b""):
            digest.update(part)
    return digest.hexdigest()


def hashes(folder: str) -> dict[str, str]:
    """SHA-256 of every file of a bundle, by path within it; hidden files and the manifest aside."""
    root = Path(folder)
    return {str(p.relative_to(root)): sha256_of(str(p)) for p in sorted(root.rglob("*")) if p.is_file() and p.name != "manifest.json" and not p.name.startswith((".", "_"))}


def write_manifest(folder: str, counts: dict, inputs: dict[str, str] | None = None, version: str = "1.0.0") -> dict:
    found = {"schema_version": version, "created_at": datetime.now(timezone.utc).isoformat(), "counts": counts, "inputs": inputs or {}, "files": hashes(folder)}
    write_document(found, f"{folder}/manifest.json")
    return found


def lineage(steps: list[tuple[str, list[str], list[str], dict]]) -> dict:
    """A lineage document from (step, inputs, outputs, parameters)."""
    return {"steps": [{"name": n, "inputs": i, "outputs": o, "parameters": p} for n, i, o, p in steps]}


def validate(folder: str) -> list[str]:
    """Problems of a bundle: files missing, changed or not JSON; empty if it is sound."""
    manifest = Path(folder, "manifest.json")
    if not manifest.exists():
        return ["manifest.json is missing"]
    wanted, problems = json.loads(manifest.read_text(encoding="utf-8")).get("files", {}), []
    for name, digest in wanted.items():
        path = Path(folder, name)
        if not path.exists():
            problems.append(f"{name} is missing")
            continue
        if sha256_of(str(path)) != digest:
            problems.append(f"{name} has changed")
        if path.suffix == ".json":
            try:
                for line in path.read_text(encoding="utf-8").splitlines() if path.name.startswith("part-") else [path.read_text(encoding="utf-8")]:
                    json.loads(line)
            except ValueError:
                problems.append(f"{name} is not JSON")
    return problems
