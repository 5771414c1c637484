"""Cost-balanced packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import arrow_rows, id_text, raw_bytes, stage, tidy

#: Sequences packed together; a block is this many sequences, whatever the size of the corpus.
BLOCK_SEQUENCES = 64


#: Signs that after a letter or digit begin a pre-token; none of them joins with a mark after it.
TAIL = b".,;:!?%$#&*"
#: Kinds of bytes: white space, letters and digits, signs of TAIL, parts of longer characters, any other (fixed values).
BLANK, WORD, SIGN, LONG, OTHER = range(5)
KINDS = bytes(BLANK if x in b" \t\n\r" else WORD if bytes([x]).isalnum() else SIGN if x in TAIL else LONG if x > 127 else OTHER for x in range(256))
#: Pre-tokens of vocabularies with word ends (a fixed value): none spans white space, and white space is dropped.
WORD_PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Unknown parts that are encoded in one call.
CALL = 8192
#: Bytes of text whose parts are told apart together.
GROUP = 4 << 20
#: Known parts that are looked up first; their table is small enough for a processor's own cache.
HOT = 1 << 15
#: Bytes of the longest part that is kept.
KEPT = 64
#: Texts that Spark sends to a task at once. Its usual 10,000 are 20 to 64 MB outside the heap for each task, which its allocator keeps.
ROWS = 2048


def parted(tokenizer) -> bool:
    """Whether a tokenizer's file says that it lower-cases and cuts by WORD_PARTS, so that parts between blanks can be encoded alone."""
    normal, cut = (json.loads(x.__getstate__()) if x else {} for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    kinds = [x["type"] for x in normal.get("normalizers", [normal]) if x]
    first = (cut.get("pretokenizers") or [cut])[0]
    removed = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    return bool("Lowercase" in kinds and removed and first["pattern"].get("Regex") == WORD_PARTS and getattr(tokenizer.model, "end_of_word_suffix", None) == "</w>")


class PieceCache:
    """Token ids of texts, with those of the parts met before looked up.

    For tokenizers that are ``parted``: a text's ids are those of its parts in order. Parts end at
    white space, and between a letter or digit and a sign of TAIL. Those of a group of texts are
    looked up by two calls of Arrow; unknown ones are encoded in few calls. Parts and ids lie in
    arrays, with no Python object for each. Beyond ``most`` parts the half of that met most often
    stays; parts of over KEPT bytes are not kept. Any other tokenizer encodes whole texts.
    """

    def __init__(self, tokenizer, kind: str, most: int = 600_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.kind, self.width, self.most, self.parted = tokenizer, kind, int(kind[2]), most, parted(tokenizer)
        self.letters = Tokenizer(tokenizer.model)
        self.letters.pre_tokenizer = WhitespaceSplit()
        vocabulary = tokenizer.get_vocab(True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.spelling = spelling(tokenizer) if self.parted else {}
        self.spelt = r"\A[" + "".join(map(chr, self.spelling)) + r"]+\z"
        self.parts, self.pool = pa.array([], pa.binary()), np.empty(0, kind)
        self.sizes, self.met = np.empty(0, np.int32), np.empty(0, np.int64)
        self.before_sign = np.full(1 << 16, -1, np.int8)  # whether a sign after this character begins a pre-token; -1: not known yet

    def ids(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text) of the texts, group by group, in order; a text over GROUP bytes is a group of its own."""
        i = 0
        while i < len(texts):
            j, size = i + 1, len(texts[i])
            while j < len(texts) and size + len(texts[j]) < GROUP:
                size += len(texts[j])
                j += 1
            group = texts[i:j]
            if not self.parted:
                found = [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast([x.decode() for x in group], add_special_tokens=False)]
                yield np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
            elif size < 2 * GROUP:
                yield self._group(group)
            else:  # one long text, in pieces that end at blanks
                found = [self._group([x])[0] for x in blank_pieces(group[0], GROUP)]
                ids = np.concatenate(found)
                yield ids, np.array([len(ids)])
            i = j

    def _group(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts, edges = self._split(texts)
        which = pc.fill_null(pc.index_in(parts, value_set=self.parts.slice(0, HOT)), -1).to_numpy().copy()
        rest = np.flatnonzero(which < 0)
        if len(rest):
            told = parts.take(pa.array(rest)).dictionary_encode()
            which[rest] = self._places(told.dictionary)[told.indices.to_numpy()]
        own = self.sizes[which]
        found = self.pool[spans((np.cumsum(self.sizes, dtype=np.int32) - self.sizes)[which], own)]
        self.met += np.bincount(which, minlength=len(self.met))
        self._forget()
        return found, np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(own, dtype=np.int64)])[edges])

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where each of some distinct parts, none of the first HOT, lies in ``self.parts``; unknown ones are added."""
        places = np.full(len(parts), -1, np.int32)
        found = pc.fill_null(pc.index_in(self.parts.slice(HOT), value_set=parts), -1).to_numpy()  # few parts make the table, not all known ones
        known = np.flatnonzero(found >= 0)
        places[found[known]] = known + HOT
        unknown = np.flatnonzero(places < 0)
        if len(unknown):
            places[unknown] = np.arange(len(self.parts), len(self.parts) + len(unknown), dtype=np.int32)
            self._add(parts.take(pa.array(unknown)))
        return places

    def _split(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """(parts of all texts, where each text's parts begin, and their number at the end)."""
        joined = b" ".join([*(x if b"<|" in x else x.lower() for x in texts), b""])  # special tokens are not lower-cased
        kind, data = np.frombuffer(joined.translate(KINDS), np.uint8), np.frombuffer(joined, np.uint8)
        inside, signs = kind != BLANK, kind[1:] == SIGN
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[1:] |= signs & (kind[:-1] == WORD)
        at = np.flatnonzero(signs & (kind[:-1] == LONG)) + 1
        first[at[self._begin(data, at)]] = True
        begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
        edges = np.searchsorted(np.flatnonzero(first), begins)
        data = data[inside]
        offsets = np.append(np.flatnonzero(first[inside]), len(data)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]), edges

    def _begin(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the signs at ``at``, each after a character of two bytes or more, begin a pre-token; of four bytes: no, such parts are encoded whole."""
        c, b, a = (data[at - i].astype(np.int32) for i in (1, 2, 3))  # after two bytes at the start, a is any byte and not used
        code = np.where(b >= 0xC0, (b & 0x1F) << 6 | c & 0x3F, np.where(a >= 0xE0, (a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F, 0))
        for x in np.unique(code[self.before_sign[code] < 0]).tolist():
            text = self.tokenizer.normalizer.normalize_str(chr(x) + TAIL[:1].decode())
            self.before_sign[x] = x > 0 and self.tokenizer.pre_tokenizer.pre_tokenize_str(text)[-1][0] == text[-1]
        return self.before_sign[code] == 1

    def _add(self, parts: pa.Array) -> None:
        """Encode and append new parts. Words of letters alone go as one text, those of ``spelling`` past the normaliser."""
        text = parts.cast(pa.string())
        way = np.where(pc.and_(pc.ascii_is_alpha(text), pc.ascii_is_lower(text)).to_numpy(zero_copy_only=False), 0, 3)
        rest = np.flatnonzero(way)
        way[rest[pc.match_substring_regex(text.take(pa.array(rest)), self.spelt).to_numpy(zero_copy_only=False)]] = 1
        rest = np.flatnonzero(way == 3)
        way[rest[np.fromiter((x.isalpha() for x in text.take(pa.array(rest)).to_pylist()), bool, len(rest))]] = 2
        ids, sizes, order = [], [], np.argsort(way, kind="stable")
        for i, encode in enumerate((partial(self._joined, self.letters), partial(self._joined, self.letters, self.spelling), partial(self._joined, self.tokenizer), self._each)):
            own = order[way[order] == i]
            for j in range(0, len(own), CALL):
                found = encode(text.take(pa.array(own[j : j + CALL])))
                ids.append(found[0])
                sizes.append(found[1])
        ids, sizes, back = np.concatenate(ids), np.concatenate(sizes), np.argsort(order)
        ids = ids[spans((np.cumsum(sizes, dtype=np.int32) - sizes)[back], sizes[back])]
        self.parts, self.pool, self.sizes = pa.concat_arrays([self.parts, parts]), np.concatenate([self.pool, ids]), np.concatenate([self.sizes, sizes[back]])
        self.met = np.concatenate([self.met, np.zeros(len(parts), np.int64)])

    def _forget(self) -> None:
        kept = np.flatnonzero(pc.binary_length(self.parts).to_numpy() <= KEPT)
        if len(kept) > self.most:
            kept = kept[np.argsort(-self.met[kept], kind="stable")[: self.most // 2]]  # so the first HOT are those met most often
            self.met //= 2
        if len(kept) < len(self.parts):
            self.pool = self.pool[spans((np.cumsum(self.sizes, dtype=np.int32) - self.sizes)[kept], self.sizes[kept])]
            self.parts, self.sizes, self.met = self.parts.take(pa.array(kept)), self.sizes[kept], self.met[kept]

    def _each(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), self.kind), np.fromiter(map(len, found), np.int32, len(found))

    def _joined(self, tokenizer, *words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, encoded as one text and parted again at the ids that end a word; with a spelling, as it says."""
        *table, words = words
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        raw = np.array(tokenizer.encode_batch_fast([text.translate(*table) if table else text], add_special_tokens=False)[0].ids, self.kind)
        sizes = np.diff(np.flatnonzero(self.ends[raw]), prepend=-1).astype(np.int32)
        return (raw, sizes) if len(sizes) == len(words) else self._each(words)  # else some letter became two pre-tokens


def spelling(tokenizer) -> dict[int, str]:
    """Letters of up to two bytes -> how the tokenizer's model spells them, for those that stay one letter.

    Those letters (below U+0530) join with marks alone, so a word of them is spelt letter by letter.
    """
    found = {}
    for x in filter(str.isalpha, map(chr, range(0x530))):
        text = tokenizer.normalizer.normalize_str(x)
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str(text)
        if text.isalpha() and len(pieces) == len(text) == 1:
            found[ord(x)] = pieces[0][0]
    return found


@lru_cache(maxsize=1)
def piece_cache(tokenizer_path: str, end_id: int | None) -> PieceCache:
    """The cache of a process: Spark's Python workers serve many tasks, and a later one finds what the earlier have met."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    return PieceCache(tokenizer, "<u2" if max(tokenizer.get_vocab_size(True), end_id or 0) < 65536 else "<u4")


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ... and so on; their number must be below 2**31."""
    at = np.repeat(starts - (np.cumsum(sizes, dtype=np.int32) - sizes), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return at


def blank_pieces(text: bytes, size: int) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that end at a blank; a longer run without blanks stays whole."""
    i = 0
    while i < len(text):
        j = text.find(b" ", i + size)
        j = len(text) if j < 0 else j
        yield text[i:j]
        i = j


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_ids, part, part_start): each document's ids, two or four little-endian bytes each.

    A null text counts as empty. part is the task that wrote the row and part_start the ids before
    it there, so that a running total needs one number per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = piece_cache(tokenizer_path, end_id)
        width, end = cache.width, None if end_id is None else np.array(end_id, cache.kind)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            row = 0
            for own, sizes in cache.ids(raw_bytes(batch.column(1))):
                if end is not None:
                    own, sizes = np.insert(own, np.cumsum(sizes), end), sizes + 1
                edges = np.concatenate([[0], np.cumsum(sizes)])
                starts = before + edges[:-1]
                before += int(edges[-1])
                n, raw = len(sizes), own.tobytes()
                ids = pa.array([raw[a:b] for a, b in zip((edges[:-1] * width).tolist(), (edges[1:] * width).tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), ids, pa.array(sizes), pa.array(np.full(n, part, np.int32)), pa.array(starts), pa.array(np.full(n, width, np.int32))], ["doc_id", "ids", "n_ids", "part", "part_start", "width"])
                row += n

    return id_text(docs, id_col, text_col).mapInArrow(tidy(run, ROWS), "doc_id long, ids binary, n_ids long, part int, part_start long, width int")


def cut(placed: DataFrame, size: int) -> DataFrame:
    """(block, at, doc_id, start, ids, doc_tokens, width): ``placed`` (doc_id, ids, n_ids, width, at) cut where a block of ``size`` ids ends."""
    piece = f"""inline(transform(sequence(at div {size}, (at + n_ids - 1) div {size}), b -> struct(
        b as block, greatest(at, b * {size}) as at, greatest(b * {size} - at, 0L) as start,
        substring(ids, cast(greatest(b * {size} - at, 0L) * width as int) + 1, cast((least(n_ids, (b + 1) * {size} - at) - greatest(b * {size} - at, 0L)) * width as int)) as ids)))"""
    pieces = placed.filter("n_ids > 0").selectExpr("doc_id", "n_ids as doc_tokens", "width", piece)
    return pieces.select("block", "at", "doc_id", "start", "ids", "doc_tokens", "width")


def balance(lengths: np.ndarray, capacities: np.ndarray, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill the sequences exactly.

    Documents go longest first (cost grows with length) to the sequence of lowest cost among those
    with room for the whole document; one that fits nowhere fills the sequence with most room and
    the rest of it is placed the same way. The lengths' sum must equal the capacities'.
    """
    room, cost = capacities.astype(np.int64).copy(), np.zeros(len(capacities))
    pieces = []
    for d in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[d])
        while left:
            k = int(np.where(room >= left, cost, np.inf).argmin())
            if room[k] < left:  # it fits nowhere
                k = int(room.argmax())
            n = min(left, int(room[k]))
            pieces.append((int(d), start, n, k, int(capacities[k] - room[k])))
            room[k] -= n
            cost[k] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return pieces


def capacities(total: int, length: int) -> np.ndarray:
    """Whole sequences, then the powers of two that make up the rest, so that nothing is padded."""
    rest = total % length
    return np.array([length] * (total // length) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1], np.int64)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int | None = 2, linear: float = 1.0, quadratic: float = 1 / 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents' tokens into sequences of ``length``.

    The corpus is one run of ids; blocks of BLOCK_SEQUENCES sequences cut it at fixed places, so a
    block holds the same bounded number of ids however long or frequent its documents are. Within
    a block, documents go in descending order to the sequence of lowest estimated attention cost
    (linear * n + quadratic * n * n per piece) that has room, and are cut where none has.

    Returns per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id,
    offset, sequence_length. Every sequence is full; only the corpus's last ids form shorter ones,
    whose lengths are powers of two. Null and empty texts hold the end id alone (with no end id,
    they have no piece); repeated rows are documents of their own; null ids stay null.
    """
    with arrow_rows(docs.sparkSession, ROWS):
        table = stage(token_table(docs, tokenizer_path, end_id, id_col, text_col), "tokens")
    totals = table.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_ids")).alias("n")).orderBy("part").collect()  # one row per task
    offsets, before = [], 0
    for row in totals:
        offsets.append((row["part"], before))
        before += row["n"]
    offsets = table.sparkSession.createDataFrame(offsets, "part int, before long")
    placed = table.join(F.broadcast(offsets), "part").select("doc_id", "ids", "n_ids", "width", (F.col("before") + F.col("part_start")).alias("at"))
    size = length * BLOCK_SEQUENCES

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        ids, width = table["ids"].to_pylist(), table["width"][0].as_py()
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        room = capacities(int(lengths.sum()), length)
        d, a, n, k, offset = (np.array(x, np.int64) for x in zip(*sorted(balance(lengths, room, linear, quadratic), key=lambda p: (p[3], p[4])), strict=True))
        first = table["block"][0].as_py() * BLOCK_SEQUENCES
        wide = [np.frombuffer(ids[i], f"<u{width}", m, s * width).astype("<u4").tobytes() for i, s, m in zip(d, a, n, strict=True)]
        take = table.take(pa.array(d))
        return pa.table({"doc_id": take["doc_id"], "start": pa.array(take["start"].to_numpy() + a), "length": pa.array(n), "ids": pa.array(wide, pa.binary()), "doc_tokens": take["doc_tokens"], "sequence_id": pa.array(first + k), "offset": pa.array(offset), "sequence_length": pa.array(room[k])})

    return cut(placed, size).groupBy("block").applyInArrow(fill, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long")


def op1_pack(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


QUERIES = {"op1_pack": op1_pack}
ORACLE_SQL: dict[str, str] = {}
