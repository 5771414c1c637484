from pyspark.sql import functions as F

from versicle.functions import text as T
from versicle.operators import matching

END = "[।॥;,.\\-–—:!?()]+"


def test_tokens_and_collapse_equal_the_patterns(spark):
    """Every character as a blank or at the ends of words, against the patterns that say what is meant."""
    points = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"{x}a{x}b {x}{x}c,{x}. d  {x}" for x in points] + ["", " ", "--a--b-- (c) ...", "ਰਹਾਉ a", "a ੧੨ ੩ b।c॥", "the end.", " a", "a "]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    plain = F.trim(F.regexp_replace("t", "(?U)\\s+", " "))
    cleaned = F.trim(F.regexp_replace(T.structural_markers(F.col("t"))[1], "(?U)\\s+", " "))
    words = F.filter(F.transform(F.split(cleaned, " "), lambda w: F.regexp_replace(w, f"^{END}|{END}$", "")), lambda w: w != "")
    got = df.select(T.collapse(F.col("t")).alias("c"), plain.alias("p"), T.tokens(F.col("t")).alias("k"), words.alias("w")).collect()
    assert [r["c"] for r in got] == [r["p"] for r in got] and [r["k"] for r in got] == [r["w"] for r in got]


def test_token_count_equals_tokens(spark):
    points = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    texts = [t for x in points for t in (f"a {x} b", f"{x} a{x}b.", f"{x}{x}")] + ["", "- a", "a -", "-- a () ...", "a — b", "ਰਹਾਉ a", "a ੧੨ ੩ b।c॥", "the end. a-b (c)", "a;b"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select(T.collapse(F.col("t")).alias("t"))
    assert df.filter(~T.token_count(F.col("t")).eqNullSafe(F.size(T.tokens(F.col("t"))))).count() == 0


def test_runs_equal_whole_lines():
    """Matches run by run are those of the whole line; each distinct run is resolved once."""
    import random

    forms = {"a b": [("AB", 0)], "b": [("B", 1), ("B2", 2)], "b c": [("BC", 3)], "c": [("C", 4)], "a b c d": [("ABCD", 5)]}
    longest = {"a": [2, 4], "b": [1, 2], "c": [1]}
    rng, asked = random.Random(1), []
    texts = [None, "", " ", *(" ".join(rng.choice("abcdxy") for _ in range(rng.randrange(30))) for _ in range(300)), "b x" * 50]

    def find(run):
        asked.append(run)
        return matching.resolve(matching.scan(run, forms, longest))

    got = matching._in_runs(texts, frozenset("abcd"), find).to_pylist()
    want = matching._spans([matching.resolve(matching.scan(t, forms, longest)) if t else [] for t in texts]).to_pylist()
    assert got == want and len(asked) == len(set(asked))
    assert matching._in_runs([None, "x"], frozenset("a"), find).to_pylist() == [[], []]
