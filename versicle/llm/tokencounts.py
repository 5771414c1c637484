"""Token counts of sections by offset-mapped attribution."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import tidy

#: Pre-tokens of the byte-level vocabularies (a fixed value: the published pattern of that family).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LINE = re.compile(r"[^\n]+")
RULES = ("majority", "first", "last")


class Encoder:
    """A byte-level vocabulary from its file of ranks (a token in base 64 and its id on each line)."""

    def __init__(self, ranks_path: str, pattern: str = BYTE_LEVEL):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def spans(self, text: str) -> np.ndarray:
        """(n, 2) character spans of the ids of a whole text, in order; a token with part of a character spans all of it."""
        if not text:
            return np.empty((0, 2), np.int64)
        sizes = self.sizes[self.encoding.encode_to_numpy(text, disallowed_special=())]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        raw = text.encode()
        if len(raw) > len(text):
            character = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # the number of characters begun up to each byte
            starts, ends = character[starts] - 1, character[ends - 1]
        return np.stack([starts, ends], axis=1)


def attribute(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Section index of each token span, and whether it crosses a boundary.

    Sections are disjoint and ascending. A token goes to the one section it overlaps. One that
    overlaps several is a crossing token: "majority" gives it to the section with most of its
    characters (ties: the earlier), "first" and "last" to the first or last one. A token that
    overlaps none (it lies in a gap, such as a line end) goes to the section before it, or to the
    first one. Without sections the index is -1.
    """
    if not len(starts):
        return np.full(len(spans), -1), np.zeros(len(spans), bool)
    a, b = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    lo = np.searchsorted(ends, a, side="right")  # the first section that ends after the token starts
    hi = np.searchsorted(starts, b, side="left") - 1  # the last that starts before it ends
    section = np.clip(np.where(hi < lo, hi, lo), 0, len(starts) - 1)
    crossing = hi > lo
    if rule == "last":
        section[crossing] = hi[crossing]
    elif rule == "majority":
        for i in np.flatnonzero(crossing):
            k = np.arange(lo[i], hi[i] + 1)
            section[i] = k[np.argmax(np.minimum(b[i], ends[k]) - np.maximum(a[i], starts[k]))]
    return section, crossing


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of a text's lines that are not empty."""
    found = [m.span() for m in LINE.finditer(text)]
    spans = np.array(found, np.int64).reshape(-1, 2)
    return spans[:, 0], spans[:, 1]


def count_tokens(docs: DataFrame, ranks_path: str, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, pattern: str = BYTE_LEVEL) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing, doc_tokens) for every section of every document.

    Each whole text is encoded once with a byte-level vocabulary; the tokens' character spans are
    interval-joined to the sections, so the counts of a document's sections add up to its tokens.
    Sections are its lines, or the ascending disjoint (start, end) structs in ``sections_col``.
    n_crossing counts the section's tokens that touch another section too; see ``attribute``.

    A document with no section (null or empty text, or line ends alone) gives one row with section
    -1 that holds all its tokens. Repeated rows give repeated results; special strings in a text
    are ordinary text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, pattern)
        for batch in batches:
            ids, held, out = [], 0, []
            given = batch.column(2).to_pylist() if sections_col else None
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                spans = encoder.spans(text)
                if given:
                    own = np.array([(s["start"], s["end"]) for s in given[i] or [] if s], np.int64).reshape(-1, 2)
                    starts, ends = own[:, 0], own[:, 1]
                else:
                    starts, ends = line_sections(text)
                section, crossing = attribute(spans, starts, ends, rule)
                number = np.arange(len(starts)) if len(starts) else np.array([-1])
                if not len(starts):
                    starts, ends = np.zeros(1, np.int64), np.array([len(text)])
                counts = [np.bincount(np.maximum(x, 0), minlength=len(number)) for x in (section, section[crossing])]
                out.append((number, starts, ends, *counts, np.full(len(number), len(spans))))
                ids += [doc_id] * len(number)
                held += len(number)
                if held > 200_000:
                    yield table(ids, out)
                    ids, held, out = [], 0, []
            if out:
                yield table(ids, out)

    def table(ids: list, out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(ids, pa.int64()), *(pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True))]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    columns = [docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")]
    if sections_col:
        columns.append(docs[sections_col].alias("sections"))
    return docs.select(*columns).mapInArrow(tidy(run), SCHEMA)


SCHEMA = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long"


def op10_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op10_tokens": op10_tokens}
ORACLE_SQL: dict[str, str] = {}
