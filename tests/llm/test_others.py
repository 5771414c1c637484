import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from versicle.llm import decontaminate, licenses, tokencounts, toxicity, urls, warc


# --- licences ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def licence_model(small):
    return licenses.fit(small, sample=600)


def test_licences(spark, licence_model, small):
    texts = [
        "Some prose before.\nReleased under the MIT License.\nand after", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
        "The driver had no license.", "Copyright law is hard and the general public is invited.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files to deal in the Software without restriction",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.paragraph, r.family) for r in licenses.scan(df, licence_model).collect()}
    assert got == {0: (1, "MIT"), 1: (0, "Apache-2.0"), 2: (0, "GPL"), 3: (0, "CC-BY-NC"), 6: (0, "MIT")}
    found = licenses.scan(small, licence_model)
    want = {r.doc_id for r in small.filter(F.col("text").rlike("(?i)licensed under the (apache|gnu)|under the mit license|CC BY-NC|all rights reserved")).collect()}
    assert want <= {r.doc_id for r in found.collect()}


def test_notices_at_every_place_of_a_long_line(spark, licence_model):
    """Also across the places where pieces begin and end, and between many other words."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    notices = [("MIT", licenses.TEMPLATES["MIT"][0]), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("GPL", licenses.TEMPLATES["GPL"][0])]
    rows = [(1000 * k + at, " ".join([*(word() for _ in range(at)), text, *(word() for _ in range(150 - at))])) for k, (_, text) in enumerate(notices) for at in range(0, 150, 3)]
    got = collections.defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licence_model).collect():
        got[r.doc_id].add(r.family)
    missed = [d for d, _ in rows if notices[d // 1000][0] not in got[d]]
    assert len(missed) <= 0.02 * len(rows), missed


def test_recall_and_precision_of_changed_notices(spark, licence_model):
    """Notices with words changed, lost or added (one of 9 to 20, three of more), among prose; 0.9 or more of each family's and of what is found."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    rows, want = [], {}
    for family, templates in licenses.TEMPLATES.items():
        for n in range(20):
            words = rng.choice(templates).split()
            edits = rng.sample(("change", "insert", "lose"), 3 if len(words) > 20 else 1 if len(words) > 8 else 0)
            for edit in edits:
                i = rng.randrange(len(words))
                words[i : i + (edit != "insert")] = [] if edit == "lose" else [word()]
            want[len(rows)] = family
            rows.append((len(rows), "\n".join([" ".join(word() for _ in range(rng.randint(5, 60))), " ".join([*(word() for _ in range(rng.randint(0, 20))), *words, *(word() for _ in range(rng.randint(0, 20)))]), word()])))
    rows += [(len(rows) + i, x) for i, x in enumerate(["The licence of the pub was lost.", "Permission to speak was granted by the chair.", "Software is sold without warranty in this shop."] * 10)]
    got = [(r.doc_id, r.family) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licence_model).collect()]
    right = sum(want.get(d) == f for d, f in got)
    caught = collections.Counter(want[d] for d in {d for d, f in got if want.get(d) == f})
    assert right >= 0.9 * len(got) and all(caught[f] >= 18 for f in licenses.TEMPLATES), caught


def test_scan_equals_plain_scores(spark, licence_model, small):
    """Piece by piece, with sums of single n-grams, for ties and repeated rows too."""
    cache, want = licenses.HashCache(), collections.Counter()
    long = spark.createDataFrame([(5000, "aa bb " * 45 + "Released under the MIT License. " + "cc dd " * 40), (5001, "Released under the MIT License.\nReleased under the MIT License.")] * 2, "doc_id long, text string")
    frame = small.select("doc_id", "text").unionByName(long)
    for doc_id, text in frame.collect():
        for number, line in enumerate(text.split("\n")):
            words = licenses.hashes_of(line.encode(), cache)
            best = {}
            for a in range(0, max(1, len(words) - licenses.PIECE_WORDS + licenses.STRIDE), licenses.STRIDE):
                piece = words[a : a + licenses.PIECE_WORDS]
                grams = [g for b in licenses.gram_buckets(piece) for g in b]
                if len(piece):
                    raw = sum(licence_model.weight[g].astype(float) for g in grams) / len(grams) ** 0.5 + licence_model.bias
                    p = licenses.softmax(raw[None] / licence_model.temperature)[0]
                    if 1 - p[0] >= 0.5:
                        own, three = licenses.gram_set(piece), sorted(range(1, len(p)), key=lambda c: -p[c])[:3]
                        near = {c: max((len(own & t) / min(len(own), len(t)) for t in licence_model.templates[licence_model.families[c]] if min(len(own), len(t)) >= 3), default=0.0) for c in three}
                        c = max(three, key=lambda c: (near[c], p[c]))
                        if near[c] >= 0.6:
                            family = licence_model.families[c]
                            best[family] = max(best.get(family, (0, 0)), (near[c], p[c]))
            for family, (near, p) in best.items():
                want[doc_id, number, family, round(near, 6), round(p, 4)] += 1
    got = collections.Counter((r.doc_id, r.paragraph, r.family, round(r.similarity, 6), round(r.probability, 4)) for r in licenses.scan(frame, licence_model).collect())
    assert got == want and got[max(got)] == 2


def test_licence_edges(spark, edges, empty, licence_model):
    assert licenses.scan(edges, licence_model).count() == 0 and licenses.scan(empty, licence_model).count() == 0
    assert licenses.fit(empty).families[0] == licenses.UNKNOWN and licenses.fit(edges, sample=50).temperature > 0
    empty_piece = licenses.piece_edges(np.array([0, 3, 3, 100, 261]))
    assert [x.tolist() for x in empty_piece] == [[1, 3, 3, 3, 4, 4, 4, 4, 4, 4, 4], [0, 3, 23, 43, *range(100, 221, 20)], [3, 63, 83, 100, *range(160, 261, 20), 261]]


# --- revisits ----------------------------------------------------------------------------------

SCHEMA = "record_id string, warc_type string, url string, at timestamp, status int, headers map<string,string>, payload_digest string, payload binary"


def brute_revisits(rows):
    fulls = [r for r in rows if r["warc_type"] == "response" and r["status"] == 200 and r["at"] is not None and r["c"] is not None]
    for r in rows:
        if r["warc_type"] == "revisit" or r["status"] == 304:
            earlier = [f for f in fulls if f["c"] == r["c"] and r["at"] is not None and f["at"] < r["at"]]
            f = max(earlier, key=lambda f: (f["at"], f["record_id"]), default=None)
            if f is None:
                yield r["record_id"], "missing", None
                continue
            h, g = ({k.lower(): v for k, v in (x["headers"] or {}).items()} for x in (r, f))
            tests = [(r["payload_digest"], f["payload_digest"]), *((re.sub("^W/", "", x), re.sub("^W/", "", y)) if x and y else (None, None) for x, y in ((h.get("etag"), g.get("etag")), (h.get("last-modified"), g.get("last-modified"))))]
            same = next((a == b for a, b in tests if a is not None and b is not None), None)
            yield r["record_id"], "unchecked" if same is None else "resolved" if same else "mismatch", f["record_id"]


def test_revisits_equal_a_plain_loop(spark):
    from datetime import datetime, timedelta

    rng, rows = random.Random(6), []
    for i in range(700):
        url = rng.choice(["http://www.A.example/x", "https://a.example/x/#top", "http://b.example/?utm_source=q&b=2&a=1", "http://b.example/?a=1&b=2", None])
        kind, status = rng.choice([("response", 200), ("response", 404), ("revisit", 304), ("response", 304)])
        headers = {k: v for k, v in (("ETag", rng.choice(['"1"', 'W/"1"', '"2"', None])), ("Last-Modified", rng.choice(["m", None])), ("Content-Length", "5"), ("Date", str(i))) if v}
        at = None if rng.random() < 0.05 else datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 200))
        rows.append((f"r{i:04}", kind, url, at, status, headers or None, rng.choice(["d1", "d2", None, None]), b"body%d" % i))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("canonical", F.lit("clash")).withColumn("part", F.lit(0))
    canon = {r.record_id: r.c for r in df.select("record_id", warc.canonical_url(F.col("url")).alias("c")).collect()}
    plain = [dict(zip((x.split()[0] for x in SCHEMA.split(", ")), r)) | {"c": canon[r[0]]} for r in rows]
    got = warc.resolve_revisits(df.repartition(5)).collect()
    assert sorted(((r.record_id, r.outcome, r.response_id) for r in got), key=str) == sorted(brute_revisits(plain), key=str)
    assert len({canon[r[0]] for r in rows if r[2]}) == 2
    by = {r["record_id"]: r for r in plain}
    for r in got:
        if r.outcome in ("resolved", "unchecked"):
            assert r.headers["date"] == by[r.record_id]["headers"]["Date"] and bytes(r.payload) == by[r.response_id]["payload"]
        else:
            assert r.headers is None and r.payload is None
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_hot_url_and_query(spark):
    pages = spark.createDataFrame([(i, "http://hot.example/", f"<p>{i}</p>") for i in range(300)] + [(900, None, None)], "page_id long, url string, html string")
    got = {r.record_id: r for r in warc.resolve_revisits(warc.crawl_of(pages), with_payload=False).collect()}
    assert len(got) == 602 and got["900-1"].outcome == "missing"
    assert got["299-2"].response_id == "299-0" and got["0-1"].response_id == "59-0"  # the latest by then, of the same URL
    assert warc.op6_warc(spark, "/root/testdata/sf0.001").count() == 100


def test_warc_files(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 304 Not Modified\r\nETag: \"x\"\r\n\r\n"
    record = lambda kind, b: b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:1>\r\nWARC-Target-URI: http://a.example/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(b), b)
    (tmp_path / "a.warc").write_bytes(record(b"revisit", body) + record(b"response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>\xff</p>") + b"WARC/1.1\r\nbroken\r\n\r\n")
    (tmp_path / "b.warc").write_bytes(gzip.compress(record(b"metadata", b"")))
    got = sorted(warc.read_warc(spark, str(tmp_path)).collect(), key=lambda r: r.warc_type)
    assert [(r.warc_type, r.status, bytes(r.payload)) for r in got] == [("metadata", None, b""), ("response", 200, b"<p>\xff</p>"), ("revisit", 304, b"")]
    assert got[2].headers == {"etag": '"x"'} and got[0].at.year == 2024


# --- toxicity ----------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels, rows=1500)
    known = labels.select("doc_id", "toxic")
    got = toxicity.score(docs.join(known, "doc_id", "left_semi"), model).join(known, "doc_id").toPandas()
    assert ((got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)) == got.held_out).all()
    test = got[got.held_out]
    rank = test.score.rank()
    auc = (rank[test.toxic == 1].mean() - rank[test.toxic == 0].mean()) / len(test) + 0.5
    hit = test[test.predicted == 1]
    assert auc > 0.97 and (hit.toxic == 1).mean() > 0.9 and (hit.toxic == 1).sum() > 0.8 * (test.toxic == 1).sum()
    assert ((test.score >= 0.7) == (test.predicted == 1)).all() and test.score.between(0, 1).all()


def test_toxicity_edges(spark, edges, empty):
    labels = spark.createDataFrame([(10, 1), (1, 0), (10, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    for model in (toxicity.Model(), toxicity.fit(edges, labels), toxicity.fit(empty, labels.limit(0))):
        got = toxicity.score(edges, model).collect()
        assert len(got) == edges.count() and all(0 <= r.score <= 1 for r in got)
        assert toxicity.score(empty, model).count() == 0
    kept = toxicity.without_toxic(edges, toxicity.Model())
    assert kept.columns == edges.columns and kept.count() == edges.count()


def test_terms_equal_plain_counts(spark):
    """Learned terms are those of a plain count over the folds, with no bound on a text's length."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, i % 4, int(i % 3 == 0), " ".join([*rng.choices(vocabulary, k=20), *(["vexatious!"] if i % 3 == 0 else [])]) + " pad" * (300_000 if i == 0 else 0)) for i in range(60)]
    sample = spark.createDataFrame(rows, "doc_id long, fold int, y int, text string")
    sizes = collections.Counter((f, y) for _, f, y, _ in rows)
    counts = toxicity.unit_counts(sample)
    for folds in ([0, 1, 2, 3], [1, 3]):
        bags = [(y, {u for w in toxicity.words_of(t) for u in toxicity.units(w.strip("!"))}) for _, f, y, t in rows if f in folds]
        n1, n0 = sum(y for y, _ in bags) + 1, sum(1 - y for y, _ in bags) + 1
        want = {}
        for u in set().union(*(b for _, b in bags)):
            c1, c0 = sum(y for y, b in bags if u in b), sum(1 - y for y, b in bags if u in b)
            odds = np.log((c1 + 0.5) / n1 * n0 / (c0 + 0.5))
            if c1 >= toxicity.LEARNED_LEAST and odds > 2:
                want[u] = min(odds, 9.0)
        got = toxicity.learn_terms(counts, sizes, folds)
        assert want and got == pytest.approx(want)


def test_long_and_orphaned_labels(spark, monkeypatch):
    """Labels without a document take no place among the rows; an over-long labelled text is learned from."""
    docs = spark.createDataFrame([(i, ("vexatious " if i % 2 else "pleasant ") * (60_000 if i == 1 else 3)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 0) for i in range(1000, 3000)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity.Model, "fit", lambda self, x, y, fold, terms: seen.append((x, y, terms)) or self)
    toxicity.fit(docs, labels, rows=100)
    (x, y, terms), = seen
    kept = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(y) == len(kept) and y.tolist() == [i % 2 for i in kept] and "vexatious" in terms and x[:, 0].max() > np.log(60_000)


def test_isotonic_rises():
    at, rate = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0.0, 1, 0, 0, 1, 1]))
    assert (np.diff(rate) >= 0).all() and (np.diff(at) > 0).all()
    x = np.random.default_rng(0).normal(size=(400, 3)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    assert ((toxicity.Boosted(40).fit(x, y)(x) > 0) == (y == 1)).mean() > 0.93


# --- decontamination ---------------------------------------------------------------------------


def test_planted_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 12, 20, 40])))) for i in range(40)] + [(99, None), (98, "")]
    docs, leaks = [], set()
    for d in range(200):
        words = [word() for _ in range(rng.randint(0, 300))]
        if d % 4 == 0:
            k = rng.randrange(40)
            own = items[k][1].split()
            for i in range(2, len(own) - 2, 9):  # substitutions
                own[i] = word()
            at = rng.randint(0, len(words))
            words[at:at] = [own[0].upper() + ","] + own[1:]
            leaks.add((d, k))
        docs.append((d, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(frame, bench).collect()}
    assert got == leaks
    kept = {r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()}
    assert kept == set(range(200)) - {d for d, _ in leaks}


def test_overlaps_equal_every_diagonal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    cache = decontaminate.HashCache()
    items = {r.item_id: decontaminate.word_hashes(r.text.encode(), cache) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        words = decontaminate.word_hashes(r.text.encode(), cache)
        for i, item in items.items():
            common = np.intersect1d(words, item)
            if len(common) >= 0.5 * len(np.unique(item)) and any(decontaminate.verify(words, item, at) for at in range(-len(item) + 1, len(words))):
                want.add((r.doc_id, i))
    assert got == want


def test_decontaminate_edges(spark, edges, empty, monkeypatch):
    bench = spark.createDataFrame([(1, "You are an idiot, and a moron"), (2, None), (3, "jumps over the lazy dog and runs away from"), (3, "jumps over the lazy dog and runs away from")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(edges, bench).collect()}
    assert got == {(10, 1), (1, 3), (2, 3)}
    kept = decontaminate.decontaminate(edges, bench)
    assert kept.columns == edges.columns and kept.count() == edges.count() - 3
    assert decontaminate.overlaps(empty, bench).count() == 0 and decontaminate.overlaps(edges, bench.limit(0)).count() == 0
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 2)  # a large benchmark's seeds are shuffled
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(edges, bench).collect()} == got


# --- URLs --------------------------------------------------------------------------------------


def test_urls(spark):
    rows = ["http://WWW.cheap-pills.example.net/en/1?x", "https://a.example.org/es/5#t", "https://a.example.org/en/12", "https://a.example.org/en/2", "http://x.com/de/1", "http://x.com/fr/1", "http://freebets.example.net", None, "no scheme", "", "http://notcom/de/", "x://y://Z/é?q"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(rows)], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got[0] == ("www.cheap-pills.example.net", "/en/1", None, "block")
    assert got[1][2:] == ("example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block") and got[3][2:] == ("org/", "allow")
    assert got[4][2:] == ("com/de/", "block") and got[5][2:] == ("com/fr/", "allow") and got[6][3] == "block"
    assert got[7] == got[8] == got[9] == ("", "", None, "allow") and got[10] == ("notcom", "/de/", None, "allow") and got[11][:2] == ("y:", "//Z/é")
    assert urls.judge(df.limit(0)).count() == 0
    real = urls.op9_urls(spark, "/root/testdata/sf0.01").toPandas()
    bad = real.host.str.contains("spam|pills|bets|casino|adult|ads-track")
    assert (real[real.rule.isna() & bad].verdict == "block").all() and (real[real.rule.isna() & ~bad].verdict == "allow").mean() > 0.98


def test_segmenter_equals_all_splits():
    counts = {"the": 50, "rapist": 2, "therapist": 3, "a": 5, "in": 20, "cheap": 5, "pills": 4, "ill": 3}
    split = urls.Segmenter(counts)

    def score(words):
        return sum(split.score.get(w, split.unknown(len(w))) for w in words)

    def splits(s):
        return [[]] if not s else [[s[:i], *rest] for i in range(1, len(s) + 1) for rest in splits(s[i:])]

    for text in ("cheappills", "therapistin", "xthea", "q", "illpills", "zzzz"):
        assert abs(score(split(text)) - max(map(score, splits(text)))) < 1e-9
    assert split("cheappills") == ("cheap", "pills") and split("") == ()


# --- token counts ------------------------------------------------------------------------------


def test_token_counts_equal_whole_encoding(spark, small):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    got = collections.defaultdict(dict)
    for r in tokencounts.count_tokens(small, path).collect():
        got[r.doc_id][r.section] = (r.start, r.end, r.n_tokens, r.doc_tokens)
    for r in small.collect():
        spans = tokenizer.encode(r.text, add_special_tokens=False).offsets
        lines = [m.span() for m in re.finditer(r"[^\n]+", r.text)]
        counts = collections.Counter()
        for a, b in spans:
            over = [max(0, min(b, e) - max(a, s)) for s, e in lines]
            counts[over.index(max(over)) if max(over) else max(0, sum(s <= a for s, _ in lines) - 1)] += 1
        assert got[r.doc_id] == {i: (s, e, counts[i], len(spans)) for i, (s, e) in enumerate(lines)}


def test_token_count_edges(spark, edges, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = tokencounts.count_tokens(edges, path).collect()
    sums = collections.Counter()
    for r in got:
        sums[r.doc_id, r.doc_tokens] += r.n_tokens
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, None} and tokencounts.count_tokens(empty, path).count() == 0
    assert all(r.section == -1 and r.n_tokens == 0 for r in got if r.doc_id in (3, 4))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    encoder, rng = tokencounts.Encoder(path), random.Random(9)
    for _ in range(500):
        t = "".join(rng.choice("ab é☃😀\n\t '1s<|endoftext|>ll don't") for _ in range(rng.randint(0, 30)))
        assert encoder.spans(t).tolist() == [list(x) for x in tokenizer.encode(t, add_special_tokens=False).offsets]
    spans, starts, ends = np.array([[0, 3], [2, 9], [9, 10]]), np.array([0, 4]), np.array([4, 9])
    for rule, want in (("majority", [0, 1, 1]), ("first", [0, 0, 1]), ("last", [0, 1, 1])):
        assert tokencounts.attribute(spans, starts, ends, rule)[0].tolist() == want
    with pytest.raises(ValueError):
        tokencounts.count_tokens(edges, path, "other")
    named = spark.createDataFrame([(1, "title body text", [(0, 5), (6, 15)])], "doc_id long, text string, fields array<struct<start:int,end:int>>")
    assert [r.n_tokens for r in tokencounts.count_tokens(named, path, sections_col="fields").orderBy("section").collect()] == [1, 2]
