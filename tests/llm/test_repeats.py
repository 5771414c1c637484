import hashlib
import random

import numpy as np

from versicle.llm import repeats
from versicle.llm.repeats import maximal_repeats, op4_repeats, remove_repeats, repeats_in, without_repeats


def brute(docs, least):
    """Per document: bytes kept, removed, runs; docs are (id, text) in order."""
    seen, out = set(), []
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - least + 1):
            w = raw[i : i + least]
            if w in seen:
                gone[i : i + least] = b"\1" * least
            seen.add(w)
        runs = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(raw), sum(gone), runs, bytes(x for x, g in zip(raw, gone) if not g)))
    return out


def test_query_equals_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    got = sorted(map(tuple, op4_repeats(spark, "/root/testdata/sf0.001").collect()))
    assert got == [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute(docs, 100)]


def test_random_texts_of_few_letters(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SUFFIXES", 200)  # neighbourhoods are split too
    monkeypatch.setattr(repeats, "CHUNK", 500)
    rng = random.Random(1)
    stock = ["".join(rng.choice("ab") for _ in range(rng.randint(30, 90))) for _ in range(12)]
    docs = [(i, "".join(rng.choice([*stock, "c" * rng.randint(1, 60), "é"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, 50).collect())
    assert got == brute(docs, 50)


def test_segments_of_long_texts(monkeypatch):
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 5000).astype(np.uint8).tobytes() + b"a" * 3000
    anchors = repeats.Anchors(100, 32, np.empty(0, np.uint64))
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    key, context, at, count = anchors(text)
    covered = np.zeros(len(text) - 99, int)
    for a, n in zip(at, count):
        covered[a : a + n] += 1
    assert (covered == 1).all()  # every window has one anchor
    assert len(np.unique(key)) <= len(key) and len(context) == len(key)


def test_maximal_repeats_equal_enumeration():
    rng = random.Random(4)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(3)]
        got = {(texts[o[0][0]][o[0][1] : o[0][1] + n], tuple(sorted(o))) for n, o in repeats_in(texts, 2)}
        want = set()
        for s in {t[i:j] for t in texts for i in range(len(t)) for j in range(i + 2, len(t) + 1)}:
            places = [(k, i) for k, t in enumerate(texts) for i in range(len(t)) if t.startswith(s, i)]
            left = {texts[k][i - 1] if i else -k - 1 for k, i in places}
            right = {texts[k][i + len(s)] if i + len(s) < len(texts[k]) else -k - 1 for k, i in places}
            if len(places) > 1 and (len(left) > 1) and (len(right) > 1):
                want.add((s, tuple(places)))
        assert got == want
    assert list(maximal_repeats([], [], 2)) == []


def test_edges(spark, edges, empty):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(edges).collect()), key=str)
    assert len(got) == edges.count()
    by = {(d, n): (r, s) for d, n, r, s in got}
    n1 = len(edges.filter("doc_id = 1").first().text)
    assert by[2, n1] == (n1, 1) and by[9, 60_000] == (59_999, 1) and by[4, 0] == (0, 0)
    cut = without_repeats(edges)
    assert cut.columns == edges.columns and cut.schema == edges.schema and cut.count() == edges.count()
    assert cut.filter("doc_id = 2").first().text == "" and cut.filter("doc_id = 2").first().n_chars == 0 and cut.filter("doc_id = 4").first().text is None
    assert remove_repeats(empty).count() == 0 and without_repeats(empty).count() == 0
