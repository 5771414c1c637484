"""Exact removal of repeated substrings: maximal repeats from a common-prefix interval tree.

A corpus-wide suffix array is never built in one place. Every window of ``least`` bytes belongs to
one anchor: the k-byte substring in it with the smallest hash (the leftmost of equal ones). Equal
windows have equal anchors, so suffixes that could share ``least`` bytes meet under their anchor's
hash, and each anchor's neighbourhood is small enough for an enhanced suffix array of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ._util import GramHash, raw_bytes, shuffle_partitions, stage, tidy

#: Bytes of an anchor; bytes of text that are combined before anything is shuffled.
ANCHOR, CHUNK = 32, 16 << 20
#: A document's positions carry 23 bits of its text's hash above these bits, to tell apart texts under one id.
TAG = 40
#: Anchors this frequent in a sample are avoided where a window has another (this bears on speed alone).
HOT_SHARE, HOT_KEYS, SAMPLE_SHARE = 0.001, 50_000, 0.02
#: Suffixes sorted at once; a larger neighbourhood is split by the hash of their first ``least`` bytes.
SUFFIXES = 200_000

LOW = np.uint64((1 << 20) - 1)
SEGMENT = (1 << 20) - 1024


def lcp(a: bytes, b: bytes, least: int) -> int:
    """Length of the common prefix, or 0 if it is under ``least``."""
    if a[:least] != b[:least]:
        return 0
    lo, hi = least, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def maximal_repeats(suffixes: list[tuple[bytes, int, int]], texts: list[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences) of the maximal repeats of ``least`` bytes or more among the given suffixes.

    ``suffixes`` are (bytes, text number, start). Sorted, with the common prefix lengths of
    neighbours, they are an enhanced suffix array; a stack scan visits the intervals of its
    common-prefix tree. An interval's prefix cannot be extended to the right, as its children differ
    there; it is maximal if its left neighbours differ too (a text's start differs from all).
    Occurrences are (text number, start), all of them, in no set order.
    """
    order = sorted(suffixes)
    heights = [lcp(order[i][0], order[i + 1][0], least) for i in range(len(order) - 1)] + [0]
    stack: list[tuple[int, int]] = []  # height, first suffix
    for i, height in enumerate(heights):
        first = i
        while stack and stack[-1][0] > height:
            length, first = stack.pop()
            left = set()
            for _, n, at in order[first : i + 1]:
                left.add(texts[n][at - 1] if at else -1)
                if len(left) > 1 or -1 in left:
                    yield length, [(n, at) for _, n, at in order[first : i + 1]]
                    break
        if height and (not stack or stack[-1][0] < height):
            stack.append((height, first))


def repeats_in(texts: list[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of a neighbourhood; one of many suffixes is split so that equal prefixes stay together."""
    total = sum(max(0, len(t) - least + 1) for t in texts)
    parts = -(-total // SUFFIXES)
    if parts <= 1:
        yield from maximal_repeats([(t[i:], n, i) for n, t in enumerate(texts) for i in range(len(t) - least + 1)], texts, least)
        return
    gram = GramHash(least)
    dealt = [gram(np.frombuffer(t, np.uint8)) % np.uint64(parts) for t in texts]
    for part in range(parts):
        yield from maximal_repeats([(texts[n][i:], n, i) for n, d in enumerate(dealt) for i in np.flatnonzero(d == part).tolist()], texts, least)


def window_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours."""
    n = 1
    while 2 * n <= w:
        a = np.minimum(a[:-n], a[n:])
        n *= 2
    return np.minimum(a[: len(a) - (w - n)], a[w - n :]) if w > n else a


class Anchors:
    """Anchors of a text: (key, context hash, first window, number of windows) of each run of windows with one anchor.

    The context is the bytes of all those windows, so anchors with equal key and context hash have
    the same windows. ``hot`` anchors come after all others in the choice.
    """

    def __init__(self, least: int, k: int, hot: np.ndarray):
        self.least, self.w, self.grams, self.hot = least, least - k + 1, GramHash(k), hot

    def __call__(self, text: bytes) -> tuple[np.ndarray, ...]:
        parts = [self._segment(text[i : i + SEGMENT + self.least - 1], i) for i in range(0, max(1, len(text) - self.least + 1), SEGMENT)] if len(text) >= self.least else []
        if not parts:
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _segment(self, text: bytes, base: int) -> tuple[np.ndarray, ...]:
        key = self.grams(np.frombuffer(text, np.uint8))
        rank = key >> np.uint64(1)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)
            rank |= (self.hot[at] == key).astype(np.uint64) << np.uint64(63)
        owner = (window_min((rank & ~LOW) | np.arange(len(rank), dtype=np.uint64), self.w) & LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        count = np.diff(np.append(first, len(owner)))
        cuts = map(slice, first.tolist(), (first + count + self.least - 1).tolist())
        context = np.fromiter(map(xxh3_64_intdigest, map(text.__getitem__, cuts)), np.uint64, len(first))
        return key[owner[first]], context, first + base, count


ROW = np.dtype([("key", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("count", "u1")])


def firsts(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows in order of key, context, document and position; which of them begin a class of equal key and context, and a key."""
    order = np.lexsort((rows["at"], rows["doc"], rows["context"], rows["key"]))
    rows = {c: x[order] for c, x in rows.items()}
    new_key = np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])[: len(order)]
    return rows, new_key | np.concatenate([[True], rows["context"][1:] != rows["context"][:-1]])[: len(order)], new_key


def merged(doc: np.ndarray, at: np.ndarray, count: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, at, bytes) of runs of windows, neighbouring runs of one document joined."""
    order = np.lexsort((at, doc))
    doc, at, count = doc[order], at[order], count[order].astype(np.int64)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + count[:-1])])[: len(doc)]
    start = np.flatnonzero(new)
    return doc[start], at[start], (np.add.reduceat(count, start) if len(start) else count) + least - 1


def pack_columns(rows: dict[str, np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(rows[c], ROW[c]).tobytes() for c in ROW.names)


def unpack_columns(blob: bytes) -> dict[str, np.ndarray]:
    n, out, at = len(blob) // ROW.itemsize, {}, 0
    for c in ROW.names:
        out[c] = np.frombuffer(blob, ROW[c], n, at)
        at += n * ROW[c].itemsize
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with __doc (null ids: the least long), __text (null: empty) and __tag, 23 bits of the text's hash."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select("*", F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("__doc"), text.alias("__text"), F.shiftrightunsigned(F.xxhash64(text), 64 - 23).alias("__tag"))


def hot_anchors(source: DataFrame, least: int, k: int) -> np.ndarray:
    """Keys in more than HOT_SHARE of a sample's texts: HOT_KEYS at most, the most frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(least, k, np.empty(0, np.uint64))
        for batch in batches:
            found = [np.unique(anchors(x)[0]) for x in raw_bytes(batch.column(0))]
            key, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([None, *key.view(np.int64).tolist()], pa.int64()), pa.array([len(found), *n.tolist()], pa.int64())], ["key", "n"])

    counts = source.select("__text").sample(SAMPLE_SHARE, 5).mapInArrow(tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("key").isNull() | (F.col("n") > 8)).orderBy(F.col("key").isNotNull(), F.desc("n"), "key").limit(HOT_KEYS + 1).collect()
    texts = sum(r["n"] for r in top if r["key"] is None)
    return np.sort(np.array([r["key"] for r in top if r["key"] is not None and r["n"] > texts * HOT_SHARE], np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__doc, __tag, __spans): the byte ranges of each document that repeat earlier bytes.

    1. Each task finds its texts' anchors and combines them in chunks: of anchors with equal key and
       context only the first goes on, the others' windows are known to be repeats. A class however
       frequent thus sends one row per chunk.
    2. By key, the first of each class is found over all chunks; the others are repeats. Keys with
       several contexts are taken further, with the first of each class.
    3. Those contexts' bytes are cut from the texts and meet under their key in an enhanced suffix
       array; of each maximal repeat all occurrences but the first are repeats.
    """
    spark = docs.sparkSession
    source = keyed(docs, id_col, text_col).select("__doc", "__text", "__tag")
    hot = hot_anchors(source, least, ANCHOR)
    buckets = 4 * shuffle_partitions(spark)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, turn = Anchors(least, ANCHOR, hot), 0
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, text, tag in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                key, context, at, count = anchors(text)
                held.append((key, context, np.full(len(key), doc), at + (tag << TAG), count.astype(np.uint8)))
                size += len(text)
                if size > CHUNK:
                    turn += 1
                    yield combined(held, turn)
                    held, size = [], 0
        if held:
            yield combined(held, turn + 1)

    def combined(held: list[tuple], turn: int) -> pa.RecordBatch:
        rows, new, _ = firsts(dict(zip(ROW.names, (np.concatenate(x) for x in zip(*held, strict=True)), strict=True)))
        again = merged(rows["doc"][~new], rows["at"][~new], rows["count"][~new], least)
        rows = {c: x[new] for c, x in rows.items()}
        bucket = (rows["key"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        numbers = [b for b in range(buckets) if edges[b] < edges[b + 1]]
        blobs = [pack_columns({c: x[order[edges[b] : edges[b + 1]]] for c, x in rows.items()}) for b in numbers]
        spans = b"".join(np.ascontiguousarray(x, "<i8").tobytes() for x in again)
        # the known repeats travel with the anchors, dealt evenly
        numbers.append(int(xxh3_64_intdigest(spans) + turn) % buckets)
        kinds = [1] * len(blobs) + [0]
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(kinds, pa.int32()), pa.array([*blobs, spans], pa.binary())], ["bucket", "kind", "blob"])

    def meet(table: pa.Table) -> pa.Table:
        kinds, blobs = table["kind"].to_pylist(), table["blob"].to_pylist()
        spans = [np.frombuffer(b, "<i8").reshape(3, -1) for k, b in zip(kinds, blobs, strict=True) if not k]
        parts = [unpack_columns(b) for k, b in zip(kinds, blobs, strict=True) if k]
        ask = (np.empty(0, np.int64),) * 4
        if parts:
            rows, new, new_key = firsts({c: np.concatenate([p[c] for p in parts]) for c in ROW.names})
            spans.append(np.stack(merged(rows["doc"][~new], rows["at"][~new], rows["count"][~new], least)))
            number = np.cumsum(new_key) - 1
            several = new & (np.bincount(number, new)[number] > 1)
            ask = rows["key"][several].view(np.int64), rows["doc"][several], rows["at"][several], rows["count"][several].astype(np.int64) + least - 1
        done = np.concatenate(spans, axis=1) if spans else np.empty((3, 0), np.int64)
        n, m = done.shape[1], len(ask[0])
        return pa.table({"asked": pa.array(np.arange(n + m) >= n), "key": pa.array(np.concatenate([np.zeros(n, np.int64), ask[0]])), **{c: pa.array(np.concatenate([d, a])) for c, d, a in zip(("doc", "at", "size"), done, ask[1:], strict=True)}})

    met = stage(source.mapInArrow(tidy(gather), "bucket int, kind int, blob binary").groupBy("bucket").applyInArrow(meet, "asked boolean, key long, doc long, at long, size long"), "anchors")
    place = [F.col("doc").alias("__doc"), F.shiftright("at", TAG).alias("__tag"), F.col("at").bitwiseAND(F.lit((1 << TAG) - 1)).alias("at")]
    asked = met.filter("asked").select("key", *place, "size").groupBy("__doc", "__tag").agg(F.collect_list(F.struct("key", "at", "size")).alias("asks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            asks = batch.column(3)
            edges, flat = asks.offsets.to_pylist(), asks.values
            keys, ats, sizes = (flat.field(i).to_pylist() for i in range(3))
            seen = set()
            for i, (doc, text, tag) in enumerate(zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True)):
                if (doc, tag) in seen:  # the same document again
                    continue
                seen.add((doc, tag))
                for j in range(edges[i], edges[i + 1]):
                    for column, x in zip(out, (keys[j], doc, ats[j] + (tag << TAG), text[ats[j] : ats[j] + sizes[j]]), strict=True):
                        column.append(x)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(),) * 3 + (pa.binary(),), strict=True)], ["key", "doc", "at", "context"])
                    out = [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(),) * 3 + (pa.binary(),), strict=True)], ["key", "doc", "at", "context"])

    contexts = source.join(asked, ["__doc", "__tag"]).select("__doc", "__text", "__tag", "asks").mapInArrow(tidy(cut), "key long, doc long, at long, context binary")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, found = None, [], []
        for batch in batches:
            for k, doc, at, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    found += again(group)
                    key, group = k, []
                group.append((doc, at, context))
                if len(found) > 50_000:
                    yield table(found)
                    found = []
        yield table(found + again(group))

    def again(group: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int]]:
        group = list(dict.fromkeys(group))  # ascending document and position, from the sorted partition
        if len(group) < 2:
            return []
        out: dict[tuple[int, int], int] = {}
        for length, places in repeats_in([g[2] for g in group], least):
            spots = [(group[n][0], group[n][1] + i) for n, i in places]
            first = min(spots)
            for spot in spots:
                if spot != first and out.get(spot, 0) < length:
                    out[spot] = length
        return [(doc, at, size) for (doc, at), size in out.items()]

    def table(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        a = np.array(found, np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([pa.array(a[:, i]) for i in range(3)], ["doc", "at", "size"])

    late = contexts.repartition(buckets, "key").sortWithinPartitions("key", "doc", "at").mapInArrow(tidy(scan), "doc long, at long, size long")
    spans = met.filter("not asked").select("doc", "at", "size").unionByName(late).select(*place, "size")
    return spans.groupBy("__doc", "__tag").agg(F.collect_list(F.struct("at", "size")).alias("__spans"))


def kept_ranges(n: int, at: np.ndarray, size: np.ndarray) -> tuple[list[tuple[int, int]], int, int]:
    """Ranges left of n bytes without the spans, the number of bytes removed and of maximal removed runs."""
    order = np.argsort(at, kind="stable")
    kept, removed, runs, end, last = [], 0, 0, 0, -1
    for a, b in zip(at[order].tolist(), (at + size)[order].tolist(), strict=True):
        b = min(b, n)
        if a > end or last < 0:
            if a > end:
                kept.append((end, a))
            runs += 1
            last, removed, end = a, removed + max(0, b - max(a, end)), max(b, end)
        elif b > end:
            removed, end = removed + b - end, b
    if end < n:
        kept.append((end, n))
    return kept, removed, runs


def _with_spans(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    spans = repeated_spans(docs, least, id_col, text_col)
    return keyed(docs, id_col, text_col).join(spans, ["__doc", "__tag"], "left")


def _cut(text: bytes, offsets: tuple[int, int], at: np.ndarray, size: np.ndarray) -> tuple[bytes, int, int]:
    a, b = offsets
    if a == b:
        return text, 0, 0
    kept, removed, runs = kept_ranges(len(text), at[a:b], size[a:b])
    return b"".join(text[i:j] for i, j in kept), removed, runs


def remove_repeats(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): each text's bytes without those that repeat earlier ones.

    A byte goes if it lies in ``least`` bytes that also start earlier, in a document of smaller id or
    further left in the same one; all is judged on the input. Texts are UTF-8 bytes, so a cut may
    part a character. Null texts are empty; texts under ``least`` bytes stay whole. Rows of equal id
    and text are one document, each with its result; different texts under one id come in the order
    of their hash (23 bits of it: alike with chance 1 in 8 million); null ids come first. An empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, (edges, at, size) = raw_bytes(batch.column(1)), _flat(batch.column(2))
            out = [_cut(t, (edges[i], edges[i + 1]), at, size) for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.binary()), *(pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [x[1] for x in out], [x[2] for x in out]))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    found = _with_spans(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), least, "doc_id", "text")
    return found.select("doc_id", "__text", "__spans").mapInArrow(tidy(run), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def _flat(spans: pa.Array) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Edges per row, positions and sizes of a column of span lists (null: none)."""
    spans = spans.fill_null([])
    flat = spans.flatten()
    counts = np.array(spans.value_lengths().to_pylist() or [0], np.int64)
    edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
    return edges, flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)


def without_repeats(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeats cut from the text, columns as before; a character cut apart goes whole.

    ``n_chars_col``, if the table has it, gets the new number of characters. Every row stays, one
    of repeats alone with an empty text; null texts stay null.
    """
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(names.index(text_col))
            edges, at, size = _flat(batch.column(len(names)))
            texts = [None if not ok else _cut(t, (edges[i], edges[i + 1]), at, size)[0].decode("utf-8", "ignore") for i, (t, ok) in enumerate(zip(raw_bytes(old), old.is_valid().to_pylist(), strict=True))]
            columns = list(batch.columns[: len(names)])
            columns[names.index(text_col)] = pa.array(texts, old.type)
            if n_chars_col in names:
                k = names.index(n_chars_col)
                columns[k] = pa.array([None if t is None else len(t) for t in texts], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    found = _with_spans(docs, least, id_col, text_col)
    return found.select(*(found[c] for c in names), "__spans").mapInArrow(tidy(run), schema)


def op4_repeats(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_repeats": op4_repeats}
ORACLE_SQL: dict[str, str] = {}
