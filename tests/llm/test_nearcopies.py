import random

import corpus_pipeline
import numpy as np
from versicle.llm import nearcopies
from versicle.llm.nearcopies import near_copies, one_of_each
from versicle.llm.simhash import kept_of


def jaccard(x, y, k=5):
    a, b = ({tuple(t.lower().split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))} for t in (x, y))
    return len(a & b) / len(a | b)


def test_planted_near_copies(spark):
    """Copies with some words replaced: exactly those at 0.8 or more go, far beyond three SimHash bits."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, gone = [], set()
    for i in range(300):
        text = [word() for _ in range(rng.randint(60, 300))]
        copy = text[:]
        for j in rng.sample(range(len(text)), rng.randint(1, max(1, len(text) // 30))):
            copy[j] = word()
        rows += [(i, " ".join(text)), (1000 + i, " ".join(copy))]
        if jaccard(rows[-2][1], rows[-1][1]) >= 0.8:
            gone.add(1000 + i)
    assert 80 < len(gone) < 290
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == {i for i, _ in rows} - gone


def test_large_group(spark):
    """Many variants of one text: one stays, with lists beyond all pairs."""
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(200)]
    rows = []
    for i in range(400):
        own = base[:]
        for j in rng.sample(range(200), 2):
            own[j] = f"v{i}x{j}"
        rows.append((i, " ".join(own)))
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 400 and {r.component_id for r in got} == {0}


def test_positional_bytes(spark):
    """Who meets in a list of two positional bytes, and whom the tally of all of them lets pass."""
    rng = random.Random(7)
    own = [rng.randrange(256) for _ in range(nearcopies.BYTES)]

    def sharing(places):
        """own with one bit changed in every other byte, and the size of a set."""
        return bytearray([x if i in places else x ^ 1 << rng.randrange(8) for i, x in enumerate(own)] + [200] + [0] * 7)

    even = list(range(0, nearcopies.BYTES, 2))
    some = even[1 : nearcopies.TALLY]
    rows = [(0, sharing(range(nearcopies.BYTES))), (1, sharing([*some, 3])), (2, sharing([*some[:-1], 3])), (3, sharing(even))]
    nodes = spark.createDataFrame(rows, "node long, wide binary")
    met = nearcopies._met(nearcopies.postings(nodes), nearcopies._first)
    assert nearcopies.postings(nodes).count() == 4 * nearcopies.BYTES // 2
    assert {0, 1, 2} <= {r[x] for r in met.collect() for x in "ab"}
    assert (0, 3) not in {(r.a, r.b) for r in met.collect()}
    passed = {(r.a, r.b) for r in nearcopies.tallied(met, nodes, 0.8).collect()}
    assert (0, 1) in passed and (0, 2) not in passed


def test_pairs_in_a_crowd(spark):
    """Pairs just over 0.8 among texts that are all just below it to each other: each pair is found."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    base, rows = words(260), []
    for i in range(0, 240, 2):
        both = base + words(4)
        rows += [(i, " ".join(both + words(32))), (i + 1, " ".join(both + words(32)))]
    assert jaccard(rows[0][1], rows[2][1]) < 0.8 < jaccard(rows[0][1], rows[1][1])
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i, _ in rows}


def crowd(n, seed=8):
    """Texts in pairs just over 0.8, all just below it to each other."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    base, rows = words(260), []
    for i in range(0, n, 2):
        both = base + words(4)
        rows += [(i, " ".join(both + words(32))), (i + 1, " ".join(both + words(32)))]
    return rows


def test_rows_of_a_crowd(spark, monkeypatch):
    """A crowd of n texts that do not link makes rows in proportion to n: 16 lists and a rest, not its n * n pairs."""
    n, seen, found = 240, [], nearcopies._met

    def counted(*args):
        met = found(*args)
        seen.append(met.filter("a is not null").count())
        return met

    monkeypatch.setattr(nearcopies, "_met", counted)
    got = near_copies(spark.createDataFrame(crowd(n), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i in range(n)}
    assert 0 < sum(seen) < 20 * n < n * (n - 1) // 4


def test_blocks_of_a_crowd(spark, monkeypatch):
    """Pairs are found whether their ends are in one block or in two; nothing else links."""
    monkeypatch.setattr(nearcopies, "BLOCK", 16, raising=False)
    got = near_copies(spark.createDataFrame(crowd(120), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i in range(120)}


def test_links_of_a_large_group(spark, monkeypatch):
    """A group of n near copies hands on fewer than n links, not all that its pairs have."""
    rng, seen, found = random.Random(9), [], nearcopies.connected_components
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(200)]
    rows = [(i, " ".join([*base[: i % 200], f"v{i}", *base[i % 200 :]])) for i in range(300)]

    def counted(links, *ends):
        seen.append(links.count())
        return found(links, *ends)

    monkeypatch.setattr(nearcopies, "connected_components", counted)
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
    assert seen and sum(seen) < len(rows)


def test_lists_made_again(spark):
    """With a bit for each key, the postings are exactly those of these lists, with their labels."""
    rng = random.Random(10)
    rows = [(i, bytearray(rng.randrange(4) for _ in range(nearcopies.BYTES + 8)), -i) for i in range(60)]
    nodes = spark.createDataFrame(rows, "node long, wide binary, label long")
    every = [tuple(r) for r in nearcopies.postings(nodes).collect()]
    keys = sorted({r[0] for r in every})[::3]
    again = nearcopies.postings(nodes, nearcopies._bits(spark.createDataFrame([(k,) for k in keys * 2], "key int")))
    assert sorted(map(tuple, again.collect())) == sorted((*r, -r[1]) for r in every if r[0] in set(keys))
    assert not np.any(nearcopies._bits(spark.createDataFrame([], "key int")))


def test_texts_shuffled_once(spark, edges):
    """The rows that stay are dealt out once, for the join with the kept ids and for repeated rows."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spark.createDataFrame([(1, None, 1)], "doc_id long, own long, component_id long")
        plan = kept_of(edges, found, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2


def test_edges(spark, edges, empty):
    got = near_copies(edges).collect()
    assert len(got) == edges.count()
    by = {r.doc_id: r.component_id for r in got if r.doc_id not in (6, None)}
    assert by == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 7: 7, 8: 8, 9: 9, 10: 10, 11: 11}
    assert one_of_each(edges).columns == edges.columns
    assert near_copies(empty).count() == 0 and one_of_each(empty).count() == 0
