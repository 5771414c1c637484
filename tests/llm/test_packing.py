import cProfile
import pstats
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from versicle.llm import packing
from versicle.llm.packing import PieceCache, balance, capacities, op1_pack, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, docs, length=4096, end=2):
    """Every id in exactly one piece, sequences without gaps, full but for powers of two."""
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [end], "<u4").tobytes() for _, t in docs)
    whole, sequences = {}, {}
    for p in pieces:
        whole.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
        assert len(p.ids) == 4 * p.length
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == ps[0].sequence_length and (at == length or at & (at - 1) == 0)
    assert sum(p.length for p in pieces) == sum(len(w) // 4 for w in want)
    return whole, want


def test_pack_equals_whole_encoding(spark, small):
    docs = [(r.doc_id, r.text) for r in small.collect()]
    whole, want = check(pack(small, PATH).collect(), docs)
    got = sorted(b"".join(p.ids for p in sorted(ps, key=lambda p: p.start)) for ps in whole.values())
    assert got == want


def test_edges(edges, empty):
    docs = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    whole, _ = check(pack(edges, PATH).collect(), docs)
    assert whole[(4, 1)][0].ids == b"\2\0\0\0" and {k for k, _ in whole} == {d for d, _ in docs}
    assert pack(empty, PATH).count() == 0


def test_cache_equals_the_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    cache, rng = PieceCache(tokenizer, "<u2", most=50), random.Random(5)
    alphabet = "abzAZ .,'!<|>\n\té́İΣßñ1٣々»«-#$%&*?;:\x1c don't it's"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["<|endoftext|> x<|ENDOFTEXT|>y", "z" * 500, ""]
    for _ in range(2):
        assert encoded(cache, texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def encoded(cache, texts):
    return [x.tolist() for ids, n in cache.ids([t.encode() for t in texts]) for x in np.split(ids, np.cumsum(n)[:-1])]


def test_long_texts_and_other_tokenizers(monkeypatch):
    tokenizer = Tokenizer.from_file(PATH)
    monkeypatch.setattr(packing, "GROUP", 64)
    texts = ["Ab cd, " * 200, "", "x" * 300, "one two\nthree", " "]
    assert encoded(PieceCache(tokenizer, "<u2"), texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert not packing.parted(other) and packing.parted(tokenizer)
    assert encoded(PieceCache(other, "<u2"), texts) == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


def test_letters_that_the_normaliser_parts():
    """NFC turns some letters into a letter and a mark; a sign after them is of the mark's pre-token."""
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["\u0958, \u095b.", "x\ufb2a! \u0f43;", "\u00e9, \u0130. \u212b? \u0374, \u0374a", "\u00c9\u0391\u03a3 \u03a3. \u4e2d, \ud55c; \U00010400, \U0001f600."]
    assert encoded(PieceCache(tokenizer, "<u2"), texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_no_call_for_each_part():
    """Parts are split, looked up and encoded by arrays; the work in Python does not grow with their number."""
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioustnr\u00e9") for _ in range(9)) for _ in range(20_000)]
    cache, profile = PieceCache(Tokenizer.from_file(PATH), "<u2"), cProfile.Profile()
    profile.runcall(encoded, cache, [", ".join(words)])
    assert pstats.Stats(profile).total_calls < 3000


def test_a_process_keeps_what_it_met(monkeypatch):
    """A later task finds the parts of the earlier ones; of too many, those met most often stay."""
    assert packing.piece_cache(PATH, 2) is packing.piece_cache(PATH, 2)
    monkeypatch.setattr(packing, "HOT", 2)
    cache, added = PieceCache(Tokenizer.from_file(PATH), "<u2", most=8), []
    monkeypatch.setattr(cache, "_add", lambda parts, add=cache._add: (added.extend(parts.to_pylist()), add(parts)))
    encoded(cache, ["often often often again again " + " ".join(map("x{}".format, range(7)))])
    assert len(cache.parts) == 4 and len(added) == 9
    encoded(cache, ["often, again often", "y" * 65])
    assert added[9:] == [b",", b"y" * 65] and cache.parts.to_pylist()[:2] == [b"often", b"again"] and len(cache.parts) == 5


def test_balance_spreads_cost():
    lengths = np.array([1000, 900, 800, 700, 600, 50, 40, 6])
    room = capacities(int(lengths.sum()), 2048)
    pieces = balance(lengths, room, 1.0, 1 / 2048)
    assert sum(p[2] for p in pieces) == lengths.sum() and pieces[0][3] != pieces[1][3]  # the two longest lie apart
    assert capacities(0, 8).tolist() == [] and capacities(21, 8).tolist() == [8, 8, 4, 1]


def test_memory_outside_the_heap(spark, small, monkeypatch):
    """Texts go to Python in small batches, and tokens are cut into blocks without it; the session stays as it was."""
    key, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], packing.stage
    before = spark.conf.get(key)
    monkeypatch.setattr(packing, "stage", lambda *args: (seen.append(int(spark.conf.get(key))), write(*args))[1])
    packed = pack(small, PATH)
    assert seen == [2048] and spark.conf.get(key) == before
    assert "MapInArrow" not in packed._jdf.queryExecution().executedPlan().toString()


def test_cut_at_blocks(spark):
    """A document that lies in several blocks is cut at their ends, one that only touches an end is not."""
    rows = [(1, bytes(range(14)), 7, 2, 3), (2, bytes(range(20, 24)), 2, 2, 10), (None, b"", 0, 2, 12), (4, bytes(range(8)), 4, 2, 12)]
    got = packing.cut(spark.createDataFrame(rows, "doc_id long, ids binary, n_ids long, width int, at long"), 4).collect()
    assert sorted((r.block, r.at, r.doc_id, r.start, bytes(r.ids), r.doc_tokens) for r in got) == [
        (0, 3, 1, 0, bytes([0, 1]), 7), (1, 4, 1, 1, bytes(range(2, 10)), 7), (2, 8, 1, 5, bytes(range(10, 14)), 7), (2, 10, 2, 0, bytes(range(20, 24)), 2), (3, 12, 4, 0, bytes(range(8)), 4),
    ]


def test_query_digest(spark):
    rows = op1_pack(spark, "/root/testdata/sf0.001").collect()
    tokenizer = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows[:100]:
        ids = np.array(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [2], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
