"""Run support: errors, phase cache, run manifest, partitioned work."""

from __future__ import annotations

import hashlib
import json
import subprocess
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.bundle import sha256_of
from .sources.files import write_document

SEVERITIES = ("FATAL", "ERROR", "WARNING")


class FatalError(RuntimeError):
    """A problem that ends the run."""


@dataclass
class Errors:
    """Problems of one phase. A fatal one raises at once; so does the one that exceeds ``most``; ``strict`` takes warnings as errors."""

    phase: str
    most: int = 100
    strict: bool = False
    found: list[dict] = field(default_factory=list)

    def add(self, severity: str, kind: str, message: str, line_uid: str | None = None, **context) -> None:
        if severity not in SEVERITIES:
            raise ValueError(f"severity must be one of {SEVERITIES}")
        severity = "ERROR" if self.strict and severity == "WARNING" else severity
        self.found.append({"line_uid": line_uid, "phase": self.phase, "severity": severity, "error_type": kind, "message": message, "context": context, "timestamp": datetime.now(timezone.utc).isoformat()})
        if severity == "FATAL":
            raise FatalError(f"{self.phase}: {kind}: {message}")
        if self.count("ERROR") > self.most:
            raise FatalError(f"{self.phase}: over {self.most} errors")

    def count(self, severity: str) -> int:
        return sum(e["severity"] == severity for e in self.found)

    def take(self, rows: DataFrame, kind: str, key: str = "line_uid", severity: str = "ERROR") -> None:
        """Problems told by the rows of a frame; no more are fetched than end the run."""
        for r in rows.select(F.col(key).cast("string").alias("k")).limit(self.most + 1).collect():
            self.add(severity, kind, kind.lower(), r["k"])

    def write(self, folder: str) -> str | None:
        """``<phase>_errors.jsonl``, only if there is something to write."""
        if not self.found:
            return None
        path = Path(folder, f"{self.phase}_errors.jsonl")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(json.dumps(e, ensure_ascii=False) + "\n" for e in self.found), encoding="utf-8")
        return str(path)


def hash_of(path: str) -> str:
    """SHA-256 of a file, or of a folder's files and their names."""
    p = Path(path)
    if p.is_file():
        return sha256_of(path)
    digest = hashlib.sha256()
    for f in sorted(x for x in p.rglob("*") if x.is_file() and not x.name.startswith((".", "_"))):
        digest.update(str(f.relative_to(p)).encode() + sha256_of(str(f)).encode())
    return digest.hexdigest()


@dataclass
class PhaseCache:
    """Which phases are up to date: their inputs' and outputs' hashes as of their last run."""

    path: str

    def _read(self) -> dict:
        p = Path(self.path)
        try:
            return json.loads(p.read_text(encoding="utf-8")) if p.exists() else {}
        except ValueError:
            return {}

    def hit(self, phase: str, inputs: list[str], outputs: list[str], force: bool = False) -> bool:
        kept = self._read().get(phase)
        if force or not kept or not all(Path(x).exists() for x in [*inputs, *outputs]):
            return False
        return kept["inputs"] == {x: hash_of(x) for x in inputs} and kept["outputs"] == {x: hash_of(x) for x in outputs}

    def update(self, phase: str, inputs: list[str], outputs: list[str]) -> None:
        now = {"inputs": {x: hash_of(x) for x in inputs}, "outputs": {x: hash_of(x) for x in outputs}, "at": datetime.now(timezone.utc).isoformat()}
        write_document(self._read() | {phase: now}, self.path)

    def invalidate(self, *phases: str) -> None:
        """Forget the given phases, or all."""
        write_document({k: v for k, v in self._read().items() if phases and k not in phases}, self.path)


@dataclass
class Manifest:
    """Inputs, outputs, counts and time of a run."""

    name: str
    inputs: dict[str, str] = field(default_factory=dict)
    outputs: dict[str, str] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    started: float = field(default_factory=time.time)

    def write(self, path: str) -> dict:
        value = asdict(self) | {"seconds": round(time.time() - self.started, 3), "at": datetime.now(timezone.utc).isoformat(), "commit": commit()}
        write_document(value, path)
        return value


def commit() -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def map_partitions_by(df: DataFrame, key: str, work: Callable, schema: str) -> DataFrame:
    """``work`` on each group of rows that share a key, in Spark tasks; a failed group fails the run.

    Only for keys with groups that fit a task; group order plays no part, results have none.
    """
    return df.groupBy(key).applyInPandas(work, schema)


def session(name: str = "versicle", **settings: str) -> SparkSession:
    """A session with the settings the library counts on: UTC, adaptive plans, Arrow."""
    builder = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
