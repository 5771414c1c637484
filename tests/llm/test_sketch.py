import hashlib

from versicle.llm.sketch import Sketcher, compare_with_next, containment, sketches


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for i, (d, t) in enumerate(order):
        after, half = order[(i + 1) % len(order)][1], len(t) // 2
        yield d, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2])


def test_query_equals_plain_neighbours(spark, small):
    got = compare_with_next(small).collect()
    rows = [(r.doc_id, r.text) for r in small.collect()]
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(expected(rows))
    close = sum(r.near_edited > r.near_next for r in got)
    assert close > 0.95 * len(got) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    texts = dict(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_edges(spark, edges, empty):
    got = compare_with_next(edges).collect()
    rows = [(r.doc_id, r.text or "") for r in edges.collect()]
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(expected(rows), key=key)
    assert compare_with_next(empty).count() == 0
    one = compare_with_next(edges.filter("doc_id = 1")).first()
    assert one.near_next == 1.0 and one.fingerprint == sketches(edges.filter("doc_id = 1")).first().fingerprint
    assert sketches(edges).count() == edges.count()


def test_likenesses_equal_plain_containment(spark, small):
    """near_edited and near_next from whole sets of retained shingle hashes."""
    sketcher = Sketcher()
    order = sorted(((r.doc_id, r.text) for r in small.collect()), reverse=True)
    want = {}
    for i, (d, t) in enumerate(order):
        after, half = order[(i + 1) % len(order)][1], len(t) // 2
        own, edited, other = (set(sketcher(x.encode()).tolist()) for x in (t, t[: len(t) - half] + after[:half], after))
        like = lambda a, b, same: 1.0 if same else len(a & b) / min(len(a), len(b)) if a and b else 0.0
        want[d] = round(like(own, edited, t == t[: len(t) - half] + after[:half]), 9), round(like(own, other, t == after), 9)
    assert {r.doc_id: (round(r.near_edited, 9), round(r.near_next, 9)) for r in compare_with_next(small).collect()} == want


def test_sketch_estimates_containment_and_merges():
    sketcher = Sketcher(scale=4)
    part, other = b" ".join(b"w%d" % i for i in range(4000)), b" ".join(b"v%d" % i for i in range(40_000))
    whole = part + b" " + other
    assert containment(sketcher(part), sketcher(whole)) > 0.99 and containment(sketcher(part), sketcher(other)) < 0.05
    union = set(sketcher(part).tolist()) | set(sketcher(other).tolist())
    assert abs(len(union) - len(sketcher(whole))) <= 12  # but for shingles across the seam
    assert len(sketcher(b"")) == 0 and containment(sketcher(b""), sketcher(b"x")) == 0.0
