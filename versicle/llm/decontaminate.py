"""Benchmark decontamination by spaced seeds with substitution-tolerant verification."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import HashCache, id_text, mix64, raw_bytes, stage, tidy

#: Masks of 5 words: a window matches a mask if the words at its ones agree. Every pattern of
#: substitutions along one diagonal that ``verify`` accepts leaves one of them whole (a test enumerates them).
MASKS = ("111011", "11001011", "11111")
#: Verified overlap: a window of so many aligned words, or a whole item; so many words of an item equal at
#: least (or all of a shorter item), and so large a share of the aligned words.
WINDOW, LEAST_WORDS, LEAST_SHARE = 13, 8, 0.8
#: Diagonals so near each other are joined: one place with words inserted or lost.
SHIFT = 3
#: The seeds and words of a benchmark of up to this many seeds are sent to every task of the joins; those of a larger one are shuffled.
BROADCAST_SEEDS = 1_000_000
#: Bits of the filter of seeds that the scan of the documents asks first: 64 for a seed, within these bounds.
#: With many more seeds it lets more through, and the join does the rest.
FILTER_BITS, PROBES = (1 << 16, 1 << 27), 4

PUNCTUATION = re.compile(rb"[!-/:-@\[-`{-~]+")


def word_hashes(text: bytes, cache: HashCache) -> np.ndarray:
    """64-bit hashes of a text's words: A-Z lower-cased, ASCII punctuation and blanks between them."""
    words = PUNCTUATION.sub(b" ", text.lower()).split()
    return np.frombuffer(b"".join(map(cache.__getitem__, words)), np.uint64)


def seeds(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """A hash for each window of ``words``, of the words at the mask's ones."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, number + 1, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix64(total)


def all_seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of all masked windows; a text of fewer than LEAST_WORDS is one seed of its own."""
    if 0 < len(words) < LEAST_WORDS:
        total = np.uint64(0)
        for w in words:
            total = total * np.uint64(0x9E3779B97F4A7C15) + w
        return mix64(np.array([total])), np.zeros(1, np.int64)
    found = [seeds(words, m, i) for i, m in enumerate(MASKS)]
    return np.concatenate(found), np.concatenate([np.arange(len(x)) for x in found])


def accepted(same: np.ndarray, size: int, least: int = LEAST_WORDS, share: float = LEAST_SHARE) -> tuple[int, int, int] | None:
    """(first, columns, equal) of the overlap in ``same``, which tells of each aligned column if its words are equal.

    It is the run from the first to the last equal word if its equal words are ``share`` of it and
    of the item's ``size`` words, and ``least`` or more (or the whole of a shorter item). Else it is
    the longest run of overlapping windows of WINDOW columns, each with ``share`` of equal words.
    """
    at = np.flatnonzero(same)
    if len(at) < min(least, size):
        return None
    n = int(at[-1] - at[0]) + 1
    if len(at) >= share * max(n, size):
        return int(at[0]), n, len(at)
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] >= share * WINDOW) if len(same) >= WINDOW else at[:0]
    if not len(good):
        return None
    ends = np.flatnonzero(np.append(np.diff(good) > WINDOW, True))
    starts = np.concatenate([[0], ends[:-1] + 1])
    found = []
    for x, y in zip(good[starts].tolist(), good[ends].tolist(), strict=True):
        own = at[(at >= x) & (at < y + WINDOW)]
        found.append((len(own), int(own[0]), int(own[-1] - own[0]) + 1))
    equal, first, n = max(found, key=lambda f: (f[0], -f[1]))
    return first, n, equal


def verify(doc: np.ndarray, item: np.ndarray, at: int, least: int = LEAST_WORDS, share: float = LEAST_SHARE) -> tuple[int, int, int, int] | None:
    """(doc start, item start, words, equal words) of the overlap along one diagonal (see ``accepted``), or None.

    ``at`` is the word of ``doc`` that faces the item's first.
    """
    a, b = max(0, at), min(len(doc), at + len(item))
    if b <= a:
        return None
    found = accepted(doc[a:b] == item[a - at : b - at], len(item), least, share)
    return found and (a + found[0], a + found[0] - at, *found[1:])


def _facing(doc: np.ndarray, item: np.ndarray, at: int) -> np.ndarray:
    """For each word of ``item``, if the word of ``doc`` that faces it is equal."""
    same = np.zeros(len(item), bool)
    a, b = max(0, at), min(len(doc), at + len(item))
    same[max(0, a - at) : max(0, b - at)] = doc[a:b] == item[a - at : b - at] if b > a else False
    return same


def verify_joined(doc: np.ndarray, item: np.ndarray, at: int, then: int) -> tuple[int, int, int, int] | None:
    """As ``verify``, for an item that goes on at the diagonal ``then`` after words inserted or lost.

    The change comes where it leaves the most equal words; inserted and lost words are columns
    without equal words. ``words`` are columns.
    """
    one, two = _facing(doc, item, at), _facing(doc, item, then)
    lost, more = max(0, at - then), max(0, then - at)
    before = np.concatenate([[0], np.cumsum(one)])
    after = np.concatenate([np.cumsum(two[::-1])[::-1], [0]])
    cuts = np.arange(len(item) - lost + 1) if len(item) >= lost else np.empty(0, np.int64)
    if not len(cuts):
        return None
    cut = int(np.argmax(before[cuts] + after[cuts + lost]))
    found = accepted(np.concatenate([one[:cut], np.zeros(lost + more, bool), two[cut + lost :]]), len(item))
    if not found:
        return None
    start = found[0] if found[0] < cut else found[0] - more
    return start + (at if found[0] < cut else then), start, *found[1:]


def short_seeds(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words."""
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(rolled)]
    return mix64(rolled)


class SeedFilter:
    """A Bloom filter of hashes; what it lets through may still be no seed."""

    def __init__(self, bits: int, table: np.ndarray):
        self.shift, self.table = np.uint64(64 - (bits.bit_length() - 1)), table

    @staticmethod
    def places(hashes: np.ndarray, shift: np.uint64, probe: int) -> np.ndarray:
        return (hashes if not probe else mix64(hashes + np.uint64(probe))) >> shift

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be seeds."""
        kept = np.arange(len(hashes))
        for probe in range(PROBES):
            at = self.places(hashes[kept], self.shift, probe)
            kept = kept[self.table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) > 0]
        return kept


def seed_filter(seeds_: DataFrame, n: int) -> SeedFilter:
    bits = min(max(FILTER_BITS[0], 1 << (64 * n).bit_length()), FILTER_BITS[1])
    shift = np.uint64(64 - (bits.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([SeedFilter.places(hashes, shift, i) for i in range(PROBES)]))
            word = (at >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.empty(0, np.int64)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(first) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(mask.view(np.int64))], ["word", "mask"])

    found = seeds_.select("hash").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most FILTER_BITS / 64 rows
    table = np.zeros(bits >> 6, np.uint64)
    table[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return SeedFilter(bits, table)


def compare(doc: np.ndarray, base: int, item: np.ndarray, at: int, thens: list[int]) -> tuple[int, int, int, int] | None:
    """The best overlap of an item along the diagonal ``at``, alone or joined with one of ``thens``, as ``verify`` gives it.

    ``doc`` is the part of the document from its word ``base`` on that faces the item there.
    """
    best = verify(doc, item, at - base)
    for then in thens:
        found = verify_joined(doc, item, at - base, then - base)
        if found and (not best or found[3] > best[3]):
            best = found
    return best and (best[0] + base, *best[1:])


SCHEMA = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long, item_words long"


def words_of_items(items: DataFrame) -> DataFrame:
    """(item, item_id, n, words): each item's word hashes, eight bytes each; those without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            words = [word_hashes(x, cache) for x in raw_bytes(batch.column(2))]
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array([w.tobytes() for w in words], pa.binary())], ["item", "item_id", "n", "words"])
            yield found.filter(pa.array([len(w) > 0 for w in words], pa.bool_()))

    return items.mapInArrow(run, "item long, item_id long, n long, words binary")


def seeds_of_items(words: DataFrame) -> DataFrame:
    """(hash, item, at, n): every seed of every item, the word where it begins, and the item's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, n, raw in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                hashes, at = all_seeds(np.frombuffer(raw, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(at), item)), pa.array(at), pa.array(np.full(len(at), n))], ["hash", "item", "at", "n"])

    return words.mapInArrow(run, "hash long, item long, at long, n long")


def suspects(docs: DataFrame, filter_: SeedFilter, short: list[int]) -> DataFrame:
    """(row, doc_id, words, hits): the documents of which a seed passes the filter, with those seeds (hash, at)."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)  # FILTER_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, cache, row = shared.value, HashCache(), TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), strict=True):
                row += 1
                words = word_hashes(text, cache)
                found = [all_seeds(words)] if len(words) >= LEAST_WORDS else []
                found += [(h, np.arange(len(h))) for h in (short_seeds(words, n) for n in short)]
                hashes, at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64),) * 2
                kept = asked(hashes)
                if len(kept):
                    out.append((row, doc_id, words.tobytes(), [{"hash": h, "at": a} for h, a in zip(hashes[kept].view(np.int64).tolist(), at[kept].tolist(), strict=True)]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["row", "doc_id", "words", "hits"])

    return docs.mapInArrow(tidy(run), "row long, doc_id long, words binary, hits array<struct<hash:long,at:long>>")


def facing(asked: DataFrame) -> DataFrame:
    """(row, doc_id, item, at, thens, base, part): of (row, doc_id, words, asks), for each diagonal the document's words
    that face the item, and the other diagonals at most SHIFT away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, doc_id, words, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for ask in asks:
                    diagonals = set(ask["diagonals"])
                    for at in sorted(diagonals):
                        a = max(0, at - SHIFT)
                        thens = [at + x for x in range(-SHIFT, SHIFT + 1) if x and at + x in diagonals]
                        out.append((row, doc_id, ask["item"], at, thens, a, words[8 * a : 8 * max(a, at + ask["n"] + SHIFT)]))
                    if len(out) > 10_000:
                        yield table(out)
                        out = []
            if out:
                yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["row", "doc_id", "item", "at", "thens", "base", "part"])

    return asked.mapInArrow(tidy(run), "row long, doc_id long, item long, at long, thens array<long>, base long, part binary")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that overlap: the best verified alignment, in words.

    Texts are words (A-Z lower-cased, ASCII punctuation dropped). A pair meets if it shares a seed:
    for one of MASKS, the words at the mask's ones agree. The tables of both sides' seed hashes are
    joined; a filter of the benchmark's seeds keeps others of the documents' out of the join.
    Verification compares word by word along the hit's diagonal (see ``accepted``), and along two
    hit diagonals at most SHIFT apart; with insertions or losses at several places, only what two
    diagonals or one accept is found. Null and empty texts on either side match nothing; repeated
    documents each give rows; items are matched once per distinct text and id. Whole documents are
    scanned, once, whatever the benchmark's size.
    """
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].alias("text")).filter(F.coalesce(F.length("text"), F.lit(0)) > 0).distinct()
    words = stage(words_of_items(items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")), "items")
    short = sorted(r["n"] for r in words.filter(F.col("n") < LEAST_WORDS).select("n").distinct().collect())  # fewer than LEAST_WORDS rows
    seeds_ = stage(seeds_of_items(words), "seeds")
    n = seeds_.count()
    sent = F.broadcast if n <= BROADCAST_SEEDS else lambda df: df
    found = stage(suspects(id_text(docs, id_col, text_col), seed_filter(seeds_, n), short), "suspects")
    hits = found.select("row", F.inline("hits")).join(sent(seeds_.withColumnRenamed("at", "item_at")), "hash")
    diagonals = hits.groupBy("row", "item", "n").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("diagonals"))
    asks = diagonals.groupBy("row").agg(F.collect_list(F.struct("item", "n", "diagonals")).alias("asks"))
    faced = facing(found.join(asks, "row").select("row", "doc_id", "words", "asks")).join(sent(words), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, doc_id, item, at, thens, base, part, item_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best = compare(np.frombuffer(part, np.uint64), base, np.frombuffer(raw, np.uint64), at, thens)
                if best:
                    out.append((row, item, at, doc_id, item_id, *best, len(raw) // 8))
            columns = zip(*out, strict=True) if out else [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in f"row long, item long, at long, {SCHEMA}".split(", ")])

    verified = faced.select("row", "doc_id", "item", "at", "thens", "base", "part", "item_id", "words").mapInArrow(tidy(run), f"row long, item long, at long, {SCHEMA}")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    best = verified.groupBy("row", "item").agg(F.min_by(F.struct(*names), F.struct(-F.col("n_equal"), "at")).alias("best"))
    return best.select("best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """``docs`` without the documents that overlap any benchmark item; documents with a null id stay."""
    bad = stage(overlaps(docs, benchmark, id_col, **columns).select(F.col("doc_id").alias("__leak")).distinct(), "leaks")
    return docs.join(bad, docs[id_col].cast("long") == bad["__leak"], "left_anti")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLE_SQL: dict[str, str] = {}
