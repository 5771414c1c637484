import random

import corpus_pipeline


def test_stages_against_plain_versions(spark, tmp_path):
    """Toxic documents, copies, passages and benchmark items planted among clean documents."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    item, passage = text(25), text(60)
    docs, labels = {}, []
    for i in range(300):
        toxic = i % 5 == 0
        body = text(80).split()
        if toxic:
            for j in range(5, 80, 12):
                body[j] = rng.choice(["idiot", "moron", "stupid", "scum"])
        docs[i] = " ".join(body)
        labels.append((i, 1, int(toxic)))
    docs[1000] = docs[1001] = docs[1]  # exact copies
    docs[1002] = text(40) + " " + passage + " " + text(40)
    docs[1003] = text(40) + " " + passage + " " + text(40)
    docs[1004] = text(30) + " " + item + " " + text(30)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    names = now.columns
    seen = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        now = step(spark, now, sf)
        now.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        assert now.columns == names
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    clean = {i for i in docs if i >= 300 or i % 5}
    assert set(seen["toxicity"]) == clean
    assert set(seen["simhash"]) == clean - {1000, 1001}
    assert set(seen["suffix_array"]) == set(seen["simhash"])
    assert passage in seen["suffix_array"][1002] and passage[:100] not in seen["suffix_array"][1003] and len(docs[1003]) - len(seen["suffix_array"][1003]) >= len(passage)
    assert all(t == docs[i] for i, t in seen["suffix_array"].items() if i != 1003)
    assert set(seen["decontaminate"]) == set(seen["simhash"]) - {1004}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in pieces} == set(seen["decontaminate"]) and sum(p.length for p in pieces if p.doc_id == 2) == next(p.doc_tokens for p in pieces if p.doc_id == 2)


def test_stages_on_edges(spark, edges, empty, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(10, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "an item of the benchmark that nobody has")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, sf).count() == 0
        assert step(spark, edges, sf).count() > 0
