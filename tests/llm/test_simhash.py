import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from versicle.llm import simhash as simhash_module
from versicle.llm.components import connected_components
from versicle.llm.simhash import _near, links, near_duplicates, one_of_each, op2_simhash, simhash


def plain(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, distance=3):
    """Index of the least reached fingerprint, by comparing all with all."""
    a = np.array(fps, np.uint64)
    near, label = np.bitwise_count(a[:, None] ^ a[None, :]) <= distance, np.arange(len(a))
    while True:
        least = np.where(near, label[None, :], len(a)).min(1)
        if (least == label).all():
            return label
        label = least


def test_query_equals_brute_force(spark):
    rows = sorted(op2_simhash(spark, "/root/testdata/sf0.001").collect())
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    fps = [plain(t) for _, t in docs]
    label = components(fps)
    assert [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in rows] == [(d, f, docs[i][0]) for (d, _), f, i in zip(docs, fps, label)]


def test_edges(spark, edges, empty):
    got = near_duplicates(edges).collect()
    assert len(got) == edges.count()
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    assert by[3, 0] == by[4, 0] == by[5, 0] == 3 and by[None, 0] == 3  # without words: fingerprint zero
    assert by[2, np.array(plain(edges.filter("doc_id = 2").first().text), np.uint64).view(np.int64).item()] == 1
    kept = one_of_each(edges)
    assert kept.columns == edges.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id) == [1, 3, 6, 7, 8, 9, 10, 11] and [r.text for r in rows if not r.doc_id] == ["a text without an id"]
    assert near_duplicates(empty).count() == 0 and one_of_each(empty).count() == 0
    assert simhash(b"One  TWO", 3) == xxhash.xxh64_intdigest(b"one two", 42)


def test_blocks_and_tally():
    """Any positions that may differ leave a block whole, so that pairs meet; the tally counts equal bytes."""
    for distance in range(5):
        for differ in itertools.combinations(range(8), distance):
            assert any(not set(differ) & set(b) for b in simhash_module.blocks(distance))
    assert len(simhash_module.blocks(3)) == 14
    a, b = np.random.default_rng(3).integers(0, 256, (2, 500, 8), dtype=np.uint8)
    b[::2, :5] = a[::2, :5]
    assert (simhash_module.tally((a.view(np.uint64) ^ b.view(np.uint64)).ravel()) == (a == b).sum(1)).all()
    x = np.array([0, 7, 1 | 1 << 9 | 1 << 20, 15, 1 | 1 << 9 | 1 << 20 | 1 << 60], np.uint64)
    assert simhash_module.close(x, 3).tolist() == [True, True, True, False, False]


@pytest.mark.parametrize("most", [1 << 20, 100])
def test_dense_groups(spark, monkeypatch, most):
    """One large group of close fingerprints: every pair within the distance is linked in the end, also if its lists are dealt again."""
    monkeypatch.setattr(simhash_module, "LIST", most)
    rng = random.Random(2)
    center = rng.getrandbits(64)
    fps = sorted({center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(1500)} | {rng.getrandbits(64) for _ in range(500)})
    df = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)),) for f in fps], "fp long")
    found = links(df)
    assert found.count() <= 56 * len(fps)  # fewer than a list's members each, not its pairs
    root = {np.array(r.node).astype(np.uint64).item(): r.root for r in connected_components(found).collect()}
    label = components(fps)
    groups = {}
    for f, i in zip(fps, label):
        groups.setdefault(i, set()).add(root.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_flips_equal_pairs():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 13, 3000).astype(np.uint64) << np.uint64(5))
    want = components(fps.tolist(), 1)
    assert (_near(fps, 1) == want).all()
    assert len(fps) > 2048  # took the way of flips
    assert (_near(fps[:300], 3) == components(fps[:300].tolist(), 3)).all()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(edges.filter(F.lit(False))).count() == 0
