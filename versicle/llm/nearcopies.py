"""Near copies by exact shingle Jaccard: candidates from a positional-byte index of a wide SimHash, then verified."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components
from ._util import id_text, mix64, raw_bytes, release_memory, shuffle_partitions, stage, tidy
from .components import connected_components
from .decontaminate import SeedFilter, seed_filter
from .simhash import kept_of, own_hash, shingle_hashes

#: Positional bytes of the wide SimHash. Their lists are intersected two at a time (bytes 2i and 2i + 1). At
#: similarity 0.8 a byte is equal with a probability of 0.27, so a pair meets in none of the 128 lists with one of 4
#: in 100,000 (small sets: 4 in 10,000 for twelve shingles of fifteen, 1 in 100 for four of five, the worst case).
BYTES = 256
#: Bytes that a posting carries, and the most bits in which they differ in a pair that is tallied (mean 19,
#: deviation 4; 24 and 4 for four shingles of five; 64 and 6 for texts that share nothing).
HEAD, FAR = 16, 38
#: Least number of equal positional bytes of a candidate pair, also with a set of up to SMALL shingles (mean 70,
#: deviation 7; 48 and 7 for four shingles of five; 1 for texts that share nothing).
TALLY, TALLY_SMALL, SMALL = 36, 24, 20
#: A list of up to FEW members gives all its pairs at once; in a longer one each member gets the nearest of the LONG
#: before it.
FEW, LONG = 16, 2048
#: Lists of each node that are looked at first, to join most of a crowd before the others are.
EARLY = 16
#: Pairs that a task remembers, so as not to give them again for another list.
SEEN = 1 << 16
#: Members and shingles of a block of a crowd; two blocks are compared in one task.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19

_RNG = np.random.default_rng(20)
_WIDE = _RNG.integers(0, 1 << 63, BYTES // 8, dtype=np.uint64)


def signature(hashes: np.ndarray, share: float) -> bytes:
    """The wide SimHash of a set of shingle hashes, with the set's size in 8 bytes after it.

    Sets too small to be ``share`` like any other but themselves are
    one shingle here, so that those that differ do not meet.
    """
    size = len(hashes)
    if size + 1e-9 < share * (size + 1):
        hashes = np.bitwise_xor.reduce(mix64(hashes), keepdims=True)
    ones = np.zeros(8 * BYTES, np.int64)
    for i in range(0, len(hashes), 128):
        ones += np.unpackbits(mix64(hashes[i : i + 128, None] ^ _WIDE).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes() + np.uint64(size).tobytes()


def signatures(texts: DataFrame, k: int, share: float) -> DataFrame:
    """(doc_id, own, node, wide): node is the text's hash; of a text without words 0, with an empty wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
            nodes, wide = batch.column(2).to_pylist(), []
            for i, text in enumerate(raw_bytes(batch.column(3))):
                hashes = np.unique(shingle_hashes(text, k))
                if not len(hashes):
                    nodes[i] = 0
                wide.append(signature(hashes, share) if len(hashes) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(wide, pa.binary())], ["doc_id", "own", "node", "wide"])

    return texts.mapInArrow(tidy(run), "doc_id long, own long, node long, wide binary")


def _rows(column: pa.Array) -> np.ndarray:
    """Wide SimHashes, each with its size, as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BYTES + 8)


def postings(nodes: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(key, node, p, q): the positional-byte index, two lists intersected at a time; p and q are the HEAD bytes.

    With ``only``, a bit for each key, just these lists are made, and label is the node's.
    """
    lists = np.arange(BYTES // 2, dtype=np.int32) << 16
    shared = None if only is None else nodes.sparkSession.sparkContext.broadcast(only)  # 1 MB
    more = [] if only is None else ["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.ascontiguousarray(_rows(batch.column(1))[:, :BYTES])
            head = np.ascontiguousarray(wide[:, :HEAD]).view(np.int64)
            columns = [(lists + wide.view(np.uint16)).ravel(), *(np.repeat(x, len(lists)) for x in (batch.column(0).to_numpy(), head[:, 0], head[:, 1], *(batch.column(2 + i).to_numpy() for i in range(len(more)))))]
            if shared is not None:
                kept = np.flatnonzero(shared.value[columns[0] >> 3] >> (columns[0] & 7) & 1)
                columns = [x[kept] for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "node", "p", "q", *more])

    return nodes.select("node", "wide", *more).mapInArrow(tidy(run), "key int, node long, p long, q long" + ", label long" * len(more))


def _bits(keys: DataFrame) -> np.ndarray:
    """A bit for each key of a list, set for those in ``keys``: exact, and 1 MB whatever their number."""
    size = BYTES // 2 << 13

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            key = batch.column(0).to_numpy()
            np.bitwise_or.at(bits, key >> 3, np.uint8(1) << (key & 7).astype(np.uint8))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].astype(np.int32))], ["at", "mask"])

    found = keys.mapInArrow(run, "at long, mask int").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most ``size`` rows
    bits = np.zeros(size, np.uint8)
    bits[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return bits


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of bits in which heads differ (128 at most)."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.uint8)


def _nearest(head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member of one list with the nearest of the LONG before it, where that is near."""
    n, a, b = len(head), [], []
    for i in range(0, n, 64):
        first, rows, end = max(0, i - LONG), np.arange(i, min(n, i + 64)), min(n, i + 64)
        far = np.where(np.arange(first, end) < rows[:, None], _far(head[i:end, None], head[None, first:end]), 255)
        best = far.argmin(axis=1)
        kept = far[np.arange(len(rows)), best] <= FAR
        a.append(first + best[kept])
        b.append(rows[kept])
    return np.concatenate(a), np.concatenate(b)


def _across(head: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the labels that near pairs of one list join: fewer links than it has labels."""
    order = np.argsort(label, kind="stable")
    own, label = np.unique(label[order], return_inverse=True)
    head, n, a, b = head[order], len(head), [], []
    joined = np.arange(len(own))
    for i in range(0, n, 64):
        end = min(n, i + 64)
        for j in range(0, end, 4096):
            if label[j] == label[end - 1]:  # and so are all from here on
                break
            to = min(end, j + 4096)
            apart = (joined[label[i:end, None]] != joined[label[None, j:to]]) & (np.arange(i, end)[:, None] > np.arange(j, to))
            if not apart.any():
                continue
            x, y = np.nonzero(apart & (_far(head[i:end, None], head[None, j:to]) <= FAR))
            for code in np.unique(label[i + x] * len(own) + label[j + y]).tolist():
                u, v = divmod(code, len(own))
                if joined[u] != joined[v]:
                    joined[joined == joined[u]] = joined[v]
                    a.append(u)
                    b.append(v)
    return own[np.array(a, np.int64)], own[np.array(b, np.int64)]


def _lists(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Keys, nodes and heads of sorted postings, and the lists' starts and sizes."""
    key, node = table.column(0).to_numpy(), table.column(1).to_numpy()
    head = np.stack([table.column(2).to_numpy(), table.column(3).to_numpy()], axis=1).view(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key, node, head, starts, np.diff(np.append(starts, len(key)))


def _short(key: np.ndarray, head: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Places of near pairs of sorted short lists, and how far the second is behind the first."""
    for d in range(1, FEW):
        at = np.flatnonzero(key[d:] == key[:-d]) if d < len(key) else key[:0]
        if not len(at):
            break
        yield at[_far(head[at], head[at + d]) <= FAR], d


def _first(table: pa.Table) -> Iterator[tuple]:
    """(a, b, None) of near pairs, one for each member of a list at most, and the (None, None, keys) of lists that have any or may have."""
    key, node, head, starts, sizes = _lists(table)
    short = np.repeat((sizes > 1) & (sizes <= FEW), sizes)
    k, x, h = key[short], node[short], head[short]
    has = np.zeros(len(k), bool)
    for at, d in _short(k, h):
        at = at[~has[at + d]]
        has[at + d] = True
        yield x[at], x[at + d], None
    if has.any():
        yield None, None, np.unique(k[has])
    for s, m in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        a, b = _nearest(head[s : s + m])
        yield node[s + a], node[s + b], None
        if len(a) or m > LONG:
            yield None, None, key[s : s + 1]


def _second(table: pa.Table) -> Iterator[tuple]:
    """(a, b, None) of the labels (in the place of nodes) that near pairs join; of a long list a forest."""
    key, label, head, starts, sizes = _lists(table)
    short = np.repeat((sizes > 1) & (sizes <= FEW), sizes)
    k, x, h = key[short], label[short], head[short]
    for at, d in _short(k, h):
        at = at[x[at] != x[at + d]]
        yield x[at], x[at + d], None
    for s, m in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        if (label[s : s + m] != label[s]).any():
            yield *_across(head[s : s + m], label[s : s + m]), None


def _whole(rows: Callable[[pa.Table, set], Iterator[pa.RecordBatch]]) -> Callable:
    """A function of sorted Arrow batches that gives ``rows`` tables of whole keys (the first column), and a set of the task's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, set()
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            key = table.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on
            held = table.slice(last)
            yield from rows(table.slice(0, last), seen)
        if held is not None:
            yield from rows(held, seen)
        held = seen = None
        release_memory()

    return run


def _met(listed: DataFrame, found) -> DataFrame:
    """(a, b, key): what ``found`` gives for the lists, streamed from sorted partitions; a < b."""
    dealt = listed.repartition(4 * shuffle_partitions(listed.sparkSession), "key").sortWithinPartitions("key", "node")

    def rows(table: pa.Table, seen: set) -> Iterator[pa.RecordBatch]:
        for a, b, key in found(table) if len(table) > 1 else ():
            if key is not None:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.int64()), pa.array(key, pa.int32())], ["a", "b", "key"])
            elif pairs := {*zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)} - seen:
                if len(seen) > SEEN:
                    seen.clear()
                seen |= pairs
                a, b = (pa.array(x, pa.int64()) for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([a, b, pa.nulls(len(a), pa.int32())], ["a", "b", "key"])

    return dealt.mapInArrow(_whole(rows), "a long, b long, key int").distinct()


def _may_link(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Which wide SimHashes have as many positional bytes in common as TALLY says, and sizes that allow ``share``."""
    m, n = (np.ascontiguousarray(z[:, BYTES:]).view(np.int64)[:, 0] for z in (x, y))
    small, large = np.minimum(m, n), np.maximum(m, n)
    equal = (x[:, :BYTES] == y[:, :BYTES]).sum(axis=1)
    return (equal >= np.where(small <= SMALL, TALLY_SMALL, TALLY)) & (small + 1e-9 >= share * large)


def tallied(pairs: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    """(a, b) of those of ``pairs`` that ``compared`` would verify."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.array(_may_link(_rows(batch.column(2)), _rows(batch.column(3)), share))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    ends = (nodes.select(F.col("node").alias(x), F.col("wide").alias(f"wide_{x}")) for x in "ab")
    both = pairs.select("a", "b").join(next(ends), "a").join(next(ends), "b").select("a", "b", "wide_a", "wide_b")
    return both.mapInArrow(tidy(run), "a long, b long")


def shingle_sets(members: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(node, own): the shingle sets of the texts of ``members``, and of few others.

    A Bloom filter of the members goes to the texts, so that these are not shuffled.
    """
    ends = members.select(F.col("node").alias("hash"))
    shared = texts.sparkSession.sparkContext.broadcast(seed_filter(ends, ends.count()).table)  # FILTER_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, seen = SeedFilter(64 * len(shared.value), shared.value), set()
        for batch in batches:
            node, rows = batch.column(0).to_numpy(), []
            for i in asked(node.view(np.uint64)).tolist():
                if node[i] not in seen:
                    seen.add(node[i])
                    rows.append(i)
            for i in range(0, len(rows), 256):
                part = batch.take(pa.array(rows[i : i + 256]))
                sets = [np.unique(shingle_hashes(x, k)).view(np.int64) for x in raw_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "own"])

    return texts.mapInArrow(tidy(run), "node long, own array<long>").dropDuplicates(["node"])


def _forest(label: np.ndarray, part: np.ndarray | None, wide: np.ndarray, ids: list[np.ndarray], share: float) -> list[tuple[int, int]]:
    """Links of different labels by pairs whose sets have a Jaccard similarity of ``share`` or more: fewer than labels.

    ids are the sets, as numbers. With ``part``, only pairs of different parts are compared.
    """
    label, sizes, links = label.copy(), np.fromiter(map(len, ids), np.int64, len(ids)), []
    mark = np.zeros(max(int(x.max()) for x in ids) + 1, bool)
    for i in range(1, len(label)):
        apart = label[:i] != label[i]
        at = np.flatnonzero(apart if part is None else apart & (part[:i] != part[i]))
        at = at[_may_link(wide[at], wide[i : i + 1], share)] if len(at) else at
        for at in np.split(at, np.flatnonzero(np.diff(np.cumsum(sizes[at]) >> 20)) + 1) if len(at) else ():  # 8 MB of sets, or one
            at = at[label[at] != label[i]]
            if not len(at):
                continue
            mark[ids[i]] = True
            equal = np.add.reduceat(mark[np.concatenate([ids[j] for j in at.tolist()])], np.cumsum(sizes[at]) - sizes[at], dtype=np.int64)
            mark[ids[i]] = False
            found = np.unique(label[at[equal >= share * (sizes[at] + sizes[i] - equal)]])
            links += [(x, int(label[i])) for x in found.tolist()]
            label[np.isin(label, found)] = label[i]
    return links


def compared(dealt: DataFrame, share: float, across: bool = False) -> DataFrame:
    """(root_a, root_b): a forest of the links within each key of ``dealt`` (key, part, root, wide, own), exactly verified.

    Every pair of a key that passes ``_may_link`` and is not joined already is verified there, so no
    row is made for a pair: a key gives fewer links than it has members. ``across``: of different parts only.
    """

    def rows(table: pa.Table, _: set) -> Iterator[pa.RecordBatch]:
        if len(table) < 2:
            return
        table = table.combine_chunks()
        key, part, root = (table.column(i).to_numpy() for i in range(3))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        links = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
            if e - s > 1 and (root[s:e] != root[s]).any():
                lists = table.column(4).slice(s, e - s).combine_chunks()
                ends = lists.offsets.to_numpy()
                _, ids = np.unique(lists.values.to_numpy()[ends[0] : ends[-1]], return_inverse=True)
                links += _forest(root[s:e], part[s:e] if across else None, _rows(table.column(3).slice(s, e - s)), np.split(ids, ends[1:-1] - ends[0]), share)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["root_a", "root_b"])

    columns = dealt.select("key", "part", "root", "wide", "own")
    return columns.repartition(4 * shuffle_partitions(dealt.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_whole(rows), "root_a long, root_b long")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) with the roots joined that ``links`` (root_a, root_b) join."""
    return _moved(labels, connected_components(links, "root_a", "root_b"))


def _moved(labels: DataFrame, found: DataFrame) -> DataFrame:
    moved = found.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return stage(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")


def crowds(nodes: DataFrame) -> DataFrame:
    """(node, root): the components of all pairs that meet in a list and are near by their heads; root is the smallest node.

    A few lists come first, and of their pairs one for each node, so that the other lists see a
    crowd as joined but for a rest and give links of components, not pairs of nodes.
    """
    early = np.zeros(BYTES // 2 << 13, np.uint8)
    early[: EARLY << 13] = 255
    labels = nodes.select("node", F.col("node").alias("root"))
    met = stage(_met(postings(nodes.withColumn("label", F.col("node")), early).drop("label"), _first), "met")
    one = met.filter(F.col("key").isNull()).groupBy("b").agg(F.min("a").alias("a"))
    labels = _moved(labels, components.connected_components(one))
    late = ~early | _bits(met.filter(F.col("key").isNotNull()).select("key"))
    again = postings(nodes.join(labels.withColumnRenamed("root", "label"), "node"), late)
    return _moved(labels, components.connected_components(_met(again.select("key", F.col("label").alias("node"), "p", "q"), _second)))


def rooted_nodes(nodes: DataFrame, texts: DataFrame, k: int, share: float) -> DataFrame:
    """(node, root): the components of all pairs of ``share`` or more within the crowds; root is the smallest node.

    A crowd is cut into blocks. Blocks are compared in themselves first, of more than one by two
    ways of cutting; crowds that this does not join are then compared block by block.
    """
    labels = nodes.select("node", F.col("node").alias("root"))
    found = crowds(nodes).withColumnRenamed("root", "crowd")
    digits = F.hex(F.substring("wide", BYTES + 1, 4))
    size = F.conv(F.concat(*(F.substring(digits, i, 2) for i in (7, 5, 3, 1))), 16, 10).cast("long")
    sizes = found.join(nodes.select("node", size.alias("size")), "node").groupBy("crowd").agg(F.count("*").alias("n"), F.sum("size").alias("size")).filter(F.col("n") > 1)
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES))
    members = stage(found.join(sizes.select("crowd", blocks.alias("blocks")), "crowd"), "members")
    if members.isEmpty():
        return labels
    part, other = (F.pmod(F.xxhash64("node", F.lit(i)), "blocks") for i in range(2))
    sets = stage(shingle_sets(members, texts, k).join(members, "node").join(nodes, "node").withColumn("part", part), "candidates")
    once = F.array(F.xxhash64("crowd", "part", "part"))
    twice = F.array_append(once, F.xxhash64("crowd", other, F.lit(-1)))
    labels = _joined(labels, compared(sets.withColumn("root", F.col("node")).withColumn("key", F.explode(F.when(F.col("blocks") > 1, twice).otherwise(once))), share))
    cut = stage(members.filter(F.col("blocks") > 1).join(labels, "node"), "cut")
    mixed = cut.groupBy("crowd").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("crowd")
    left = stage(cut.join(mixed, "crowd").select("node", "root"), "left")
    if left.isEmpty():
        return labels
    others = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != F.col("part")))
    pairs = sets.join(left, "node").select("crowd", "part", "root", "wide", "own", others.alias("to"))
    return _joined(labels, compared(pairs.withColumn("key", F.xxhash64("crowd", F.least("part", "to"), F.greatest("part", "to"))), share, across=True))


def near_copies(docs: DataFrame, k: int = 5, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``.

    Documents link if the sets of their ``k``-word shingles (A-Z lower-cased, ASCII blanks) have a
    Jaccard similarity of ``share`` or more, compared exactly. Compared are the pairs within a crowd that
    pass TALLY, but for those that other links join; a crowd is linked by pairs that meet in a list of
    two positional bytes of their wide SimHashes (see BYTES, made for 0.8 or more) and pass FAR.
    component_id is the smallest doc_id of the component.
    Equal texts are one node whatever their number; texts without words (null, empty, blank) are
    one group; a text of fewer words than ``k`` is one shingle; an empty table gives an empty
    result; a component of null ids alone has a null component_id.
    """
    return grouped(docs, k, share, id_col, text_col).drop("own")


def grouped(docs: DataFrame, k: int, share: float, id_col: str, text_col: str) -> DataFrame:
    """``near_copies`` with own: null but for null ids, whose rows it tells apart by their text."""
    texts = id_text(docs, id_col, text_col).select("doc_id", own_hash().alias("own"), F.xxhash64("text").alias("node"), "text")
    table = stage(signatures(texts, k, share), "signatures")
    nodes = stage(table.filter(F.length("wide") > 0).select("node", "wide").dropDuplicates(["node"]), "nodes")
    found = rooted_nodes(nodes, texts.select("node", "text"), k, share)
    rooted = table.groupBy("node").agg(F.min("doc_id").alias("least")).join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return table.select("doc_id", "own", "node").join(rooted.join(ids, "root").select("node", "component_id"), "node").select("doc_id", "own", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, chosen as in ``simhash.one_of_each``."""
    return kept_of(docs, grouped(docs, k, share, id_col, text_col), id_col, text_col)
