"""SimHash near-duplicate groups by a positional-byte inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat
from math import comb
from operator import xor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import id_text, raw_bytes, shuffle_partitions, stage, tidy
from .components import connected_components

BYTES = 8
#: A list of more fingerprints is dealt again by one more byte.
LIST = 1 << 20


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """64-bit hashes of a text's ``k``-word shingles, repeats included; of fewer words, one of the whole."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - k + 1)
    if n == 1:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    cuts = map(slice, (ends - sizes)[:n].tolist(), ends[k - 1 :].tolist())
    return np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, cuts), repeat(42)), np.uint64, n)


def simhash(text: bytes, k: int) -> int:
    """Unsigned 64-bit SimHash of a text's ``k``-word shingles, repeats included."""
    hashes = shingle_hashes(text, k)
    n = len(hashes)
    if n < 2:
        return int(hashes[0]) if n else 0
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, own, fp): fp is the SimHash as a signed long. Null, empty and blank texts have fp 0.

    own is null but for null ids, whose rows it tells apart by their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(x, k) for x in raw_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], ["doc_id", "own", "fp"])

    return id_text(docs, id_col, text_col).withColumn("own", own_hash()).mapInArrow(tidy(run), "doc_id long, own long, fp long")


def own_hash(id_: str = "doc_id", text: str = "text") -> F.Column:
    """Hash of the text where the id is null, else null."""
    return F.when(F.col(id_).isNull(), F.xxhash64(F.coalesce(text, F.lit(""))))


def blocks(distance: int) -> list[tuple[int, ...]]:
    """Sets of byte positions, one of which is whole in any two fingerprints that differ in ``distance`` bytes or fewer.

    For three bytes these are the 14 sets of four positions whose numbers add up to nothing without
    carry: any three positions lie in one of them, and the four others are such a set too.
    """
    if distance == 3:
        return [x for x in combinations(range(BYTES), 4) if not reduce(xor, x)]
    return list(combinations(range(BYTES), BYTES - distance))


def _postings(fps: DataFrame, distance: int) -> DataFrame:
    """(fp, key): the positional index, its lists intersected by ``blocks``: a posting for each block and the bytes there.

    A list of over LIST fingerprints is dealt again, once for each position outside its block and
    the byte there: as at most ``distance`` of these differ, no pair is lost.
    """
    parts = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(BYTES)]
    keys = []
    for number, chosen in enumerate(blocks(distance)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, 8).bitwiseOR(parts[i])
        again = F.array(*(F.xxhash64(key, F.lit(i), parts[i]) for i in range(BYTES) if i not in chosen))
        keys.append(F.struct(key.alias("key"), F.lit(number).alias("block"), again.alias("again")))
    listed = fps.select("fp", F.inline(F.array(*keys)))
    if distance > BYTES - max(map(len, blocks(distance))) - 1:  # no further position is sure to be equal
        return listed.select("fp", "key")
    long = listed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > LIST)
    listed = listed.join(F.broadcast(long), "key", "left")  # at most one key for LIST postings
    return listed.select("fp", F.explode(F.when(F.col("n").isNull(), F.array("key")).otherwise(F.col("again"))).alias("key"))


def tally(x: np.ndarray) -> np.ndarray:
    """Number of positions at which two fingerprints have equal bytes, from their exclusive or."""
    x = x | x >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return BYTES - np.bitwise_count(x & np.uint64(0x0101010101010101))


def close(x: np.ndarray, distance: int) -> np.ndarray:
    """Which exclusive ors are of pairs that share BYTES - distance positional bytes, the least that is guaranteed, and then differ in ``distance`` bits or fewer."""
    kept = tally(x) >= BYTES - distance
    kept[kept] = np.bitwise_count(x[kept]) <= distance
    return kept


def _near(fps: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint of one list, the index of the least one reached over links within the list."""
    label = np.arange(len(fps))
    bits = np.bitwise_or.reduce(fps ^ fps[0])
    free = [np.uint64(1 << i) for i in range(64) if int(bits) >> i & 1]
    flips = sum(comb(len(free), r) for r in range(1, distance + 1))
    if len(fps) <= max(2048, flips):  # tallying with every other costs less than looking up every flip
        def neighbours() -> Iterator[tuple[slice, np.ndarray]]:
            for i in range(0, len(fps), 256):
                yield slice(i, i + 256), np.where(close(fps[i : i + 256, None] ^ fps[None, :], distance), label[None, :], len(fps)).min(axis=1)
    else:
        def neighbours() -> Iterator[tuple[slice, np.ndarray]]:
            for r in range(1, distance + 1):
                for chosen in combinations(free, r):
                    want = fps ^ np.bitwise_or.reduce(np.array(chosen, np.uint64))
                    at = np.minimum(np.searchsorted(fps, want), len(fps) - 1)
                    yield slice(None), np.where(fps[at] == want, label[at], len(fps))
    while True:
        before = label.copy()
        for rows, least in neighbours():
            label[rows] = np.minimum(label[rows], least)
        label = label[label]
        if (label == before).all():
            return label


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b) over distinct fingerprints: a spanning forest of all pairs at ``distance`` bits or fewer.

    Such a pair differs in at most ``distance`` bytes, so it meets in a list (see ``blocks``). Pairs
    that meet are tallied over all positional bytes; those that share 8 - distance, which is
    guaranteed, are verified by bit count. Lists are streamed from sorted partitions; each gives
    fewer links than it has members.
    """
    n = 4 * shuffle_partitions(fps.sparkSession)
    dealt = _postings(fps.repartition(n), distance).repartition(n, "key").sortWithinPartitions("key", "fp")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            key = np.concatenate([held_k, batch.column(1).to_numpy()])
            fp = np.concatenate([held_f, batch.column(0).to_numpy()])
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last list may go on
            held_k, held_f = key[last:], fp[last:]
            yield from found(key[:last], fp[:last])
        yield from found(held_k, held_f)

    def found(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key) < 2:
            return
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        two = two[close((fp[two] ^ fp[two + 1]).view(np.uint64), distance)]
        a, b = [fp[two]], [fp[two + 1]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            own = np.sort(fp[s : s + n].view(np.uint64))
            label = _near(own, distance)
            moved = np.flatnonzero(label != np.arange(n))
            a.append(own[label[moved]].view(np.int64))
            b.append(own[moved].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return dealt.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Documents link if their fingerprints differ in at most ``distance`` bits; component_id is the
    smallest doc_id of the component. Equal fingerprints are one node whatever their number, so
    exact copies add neither postings nor links. Texts without words (null, empty, blank) have
    fingerprint zero and link like any other; repeated rows share their component; an empty table
    gives an empty result; a component of null ids alone has a null component_id.
    """
    return grouped(docs, k, distance, id_col, text_col).drop("own")


def grouped(docs: DataFrame, k: int, distance: int, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` with own (see ``fingerprints``)."""
    table = stage(fingerprints(docs, k, id_col, text_col), "fingerprints")
    nodes = table.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    rooted = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return table.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "own", "fp", "component_id")


def one_of_each(docs: DataFrame, k: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id; columns as before.

    Repeated rows of the kept id count as copies too. Rows with a null id go if their group has
    another id; of groups with null ids alone one row of each distinct text stays.
    """
    return kept_of(docs, grouped(docs, k, distance, id_col, text_col), id_col, text_col)


def kept_of(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay of the groups in ``found`` (doc_id, own, component_id), as in ``one_of_each``."""

    def keys(id_: str, own: str) -> list[F.Column]:
        """No nulls, so that the rows are shuffled once, for the join and for the repeated ones; own is null unless the id is."""
        return [F.coalesce(id_, own).alias("__key"), F.col(id_).isNull().alias("__none")]

    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*keys("doc_id", "own")).distinct()
    rows = docs.select(*docs.columns, docs[id_col].cast("long").alias("__id"), docs[text_col].alias("__text"))
    rows = rows.withColumn("__own", own_hash("__id", "__text")).select(*docs.columns, *keys("__id", "__own"))
    return rows.join(keep, ["__key", "__none"], "left_semi").dropDuplicates(["__key", "__none"]).select(*docs.columns)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLE_SQL: dict[str, str] = {}
