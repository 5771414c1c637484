"""Fetching pages over HTTP into a folder, politely and resumably; the driver's work, one page at a time."""

from __future__ import annotations

import json
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

#: Statuses by which a server asks to be left alone, and how many in a row end the run.
BLOCKED, BLOCKS_TO_STOP = (403, 429), 3


class Blocked(RuntimeError):
    """The server refuses further requests."""


def http_get(url: str, timeout: float = 30.0) -> tuple[int, str]:
    """Status and text of a page; an HTTP error is its status and an empty text."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "versicle"}), timeout=timeout) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as problem:
        return problem.code, ""


@dataclass
class Fetcher:
    """Pages ``url.format(page)`` as ``ang_<page>.html`` under ``folder``, with the state of the run beside them."""

    url: str
    folder: str
    retries: int = 5
    delay: tuple[float, float] = (0.5, 1.5)
    least: int = 100
    get: Callable[[str], tuple[int, str]] = http_get
    sleep: Callable[[float], None] = time.sleep
    failures: list[dict] = field(default_factory=list)

    def path(self, page: int) -> Path:
        return Path(self.folder, f"ang_{page:04d}.html")

    def one(self, page: int) -> str:
        """A page's text: retried with a wait that doubles up to 32 seconds; raises Blocked or, at last, OSError."""
        reason = ""
        for attempt in range(self.retries + 1):
            try:
                status, text = self.get(self.url.format(page))
            except OSError as problem:
                status, text, reason = 0, "", str(problem)
            if status in BLOCKED:
                raise Blocked(f"page {page}: status {status}")
            if status == 200 and len(text) >= self.least:
                return text
            reason = reason or f"status {status}, {len(text)} characters"
            if attempt < self.retries:
                self.sleep(min(32.0, 2.0**attempt))
        raise OSError(f"page {page}: {reason}")

    def run(self, pages: Iterable[int], seed: int | None = None) -> dict:
        """Fetch what is not there yet; returns and keeps the state: pages done, failed, and whether it stopped early."""
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        rng, blocks, done, stopped = random.Random(seed), 0, [], False
        for page in pages:
            if self.path(page).exists() and self.path(page).stat().st_size > self.least:
                done.append(page)
                continue
            try:
                text = self.one(page)
            except (Blocked, OSError) as problem:
                self.failures.append({"page": page, "type": type(problem).__name__, "message": str(problem), "timestamp": datetime.now(timezone.utc).isoformat()})
                blocks = blocks + 1 if isinstance(problem, Blocked) else 0
                if blocks >= BLOCKS_TO_STOP:
                    stopped = True
                    break
            else:
                blocks = 0
                temporary = self.path(page).with_suffix(".part")
                temporary.write_text(text, encoding="utf-8")
                os.replace(temporary, self.path(page))
                done.append(page)
            self.sleep(rng.uniform(*self.delay))
        state = {"done": done, "failed": [f["page"] for f in self.failures], "stopped": stopped}
        Path(self.folder, "fetch_state.json").write_text(json.dumps(state), encoding="utf-8")
        Path(self.folder, "fetch_failures.jsonl").write_text("".join(json.dumps(f) + "\n" for f in self.failures), encoding="utf-8")
        return state
