import numpy as np

from versicle.llm import decontaminate as D


def words(n, start=0):
    return [f"w{start + i}" for i in range(n)]


def found(spark, pairs):
    """For each (document, item), the overlaps of the document with its own item."""
    docs = spark.createDataFrame([(i, " ".join(d)) for i, (d, _) in enumerate(pairs)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(x)) for i, (_, x) in enumerate(pairs)], "item_id long, text string")
    rows = D.overlaps(docs, items).filter("doc_id = item_id").collect()
    return [[(r.doc_start, r.item_start, r.n_words, r.n_equal) for r in rows if r.doc_id == i] for i in range(len(pairs))]


def test_part_of_a_long_item(spark):
    pairs, want = [], []
    for n, a, b in ((56, 8, 48), (200, 20, 170), (40, 5, 18)):
        item = words(n)
        pairs += [(words(30, 1000) + item[a:b] + words(30, 2000), item), (words(30, 1000) + item[a : a + 10] + words(30, 2000), item)]
        want += [[(30, a, b - a, b - a)], []]
    assert found(spark, pairs) == want


def test_substitutions_insertions_and_losses(spark):
    item = words(26)
    pairs = [(words(9, 900) + [f"x{i}" if i in (3, 8, 15, 17, 19, 21, 23) else w for i, w in enumerate(item)] + words(9, 800), item)]  # 19 of 26
    want = []
    for n in (12, 20, 25):
        item, half = words(n), n // 2
        pairs.append((words(30, 1000) + item[:half] + ["new"] + item[half:] + words(30, 2000), item))
        pairs.append((words(30, 1000) + item[:half] + item[half + 1 :] + words(30, 2000), item))
        want += [[(30, 0, n + 1, n)], [(30, 0, n, n - 1)]]
    got = found(spark, pairs)
    assert got[0] and got[1:] == want


def test_middle_word_of_short_items(spark):
    """Items of 8 to 12 words, each with any one word changed where the share allows it."""
    pairs, want = [], []
    for n in range(8, 13):
        for i in range(n):
            item = words(n)
            pairs.append((words(9, 900) + item[:i] + ["changed"] + item[i + 1 :] + words(9, 800), item))
            want.append(n - 1 >= max(D.LEAST_WORDS, D.LEAST_SHARE * n))
    assert [bool(x) for x in found(spark, pairs)] == want


def test_filter_lets_every_seed_through(spark, monkeypatch):
    hashes = np.random.default_rng(5).integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    frame = spark.createDataFrame([(int(x),) for x in hashes.view(np.int64)], "hash long")
    others = D.mix64(hashes)
    asked = D.seed_filter(frame, 3000)
    assert len(asked(hashes)) == 3000 and len(asked(others)) < 10
    monkeypatch.setattr(D, "FILTER_BITS", (1 << 10, 1 << 10))  # as with too many seeds: lets much through, loses none
    assert len(D.seed_filter(frame, 3000)(hashes)) == 3000


def fewest(masks, most):
    """For each length up to ``most``, the fewest substitutions that leave no mask whole, over all patterns."""
    span = max(map(len, masks)) - 1
    ones = [[len(m) - 1 - i for i, c in enumerate(m) if c == "1"] for m in masks]
    states, out = {(1 << span) - 1: 0}, []
    for _ in range(most):
        after = {}
        for state, cost in states.items():
            for bit in (0, 1):
                now = state << 1 | bit
                if all(any(now >> i & 1 for i in m) for m in ones):
                    key = now & (1 << span) - 1
                    after[key] = min(after.get(key, most), cost + bit)
        states = after
        out.append(min(states.values()))
    return out


def test_no_accepted_pattern_escapes_the_masks():
    """Windows and items of 8 to 79 words; longer ones are made of two or more of 40 to 79, so they hold too."""
    for n, k in enumerate(fewest(D.MASKS, 79), 1):
        if n >= D.LEAST_WORDS:
            assert n - k < max(D.LEAST_WORDS, D.LEAST_SHARE * n), n
    item = np.array([1] * D.WINDOW, bool)
    assert D.accepted(item, 100) == (0, 13, 13) and D.accepted(item[:12], 100) is None
