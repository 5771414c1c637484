"""URL filters: longest-rule lookup, host word segmentation and naive Bayes on the segmented tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import stage

#: (verdict, host, path prefix); a rule covers its host and all subdomains.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Names as site owners choose them, for the two classes, to train on. Their words are also known to the segmenter.
BLOCK_NAMES = (
    "online casino", "poker bonus", "royal casino games", "roulette table", "slots jackpot", "lottery winner", "lucky bets club", "sports betting tips", "bets today", "win big jackpot", "win real money", "blackjack bonus", "bingo bonus", "gambling guide",
    "xxx videos", "adult chat", "adult cams", "adult videos", "live sex cams", "hot escorts", "porn tube", "nude models", "hot dating", "erotic stories", "sexy singles", "hentai porn", "fetish cams",
    "buy viagra online", "cialis pharmacy", "cheap meds", "discount pills", "diet pills", "weight loss miracle", "steroids shop", "no prescription meds", "xanax pills", "cheap viagra",
    "payday loans", "fast cash loans", "bad credit loans", "free cash now", "crypto bonus", "bitcoin doubler", "forex profit", "get rich quick", "easy money system", "free gift cards",
    "spam mail", "spam links", "bulk email blast", "link farm", "backlinks seller", "seo traffic", "ad tracker", "pop ads", "ads network", "click ads", "banner ads", "track clicks", "clickbait viral", "traffic exchange", "adware bundle",
    "replica watches", "fake rolex", "cheap replica bags", "counterfeit shoes", "warez cracks", "keygen download", "serial cracks", "torrent warez", "free followers", "buy likes", "cheap followers", "phishing login",
)
ALLOW_NAMES = (
    "daily news", "weather today", "city library", "open university", "science journal", "health service", "travel guide", "music school", "history museum", "garden club", "recipe book", "football club", "public radio", "family doctor",
    "art gallery", "book review", "local council", "math notes", "language course", "bird watch", "film archive", "free software", "farm market", "track and field", "research lab", "home page", "the other one", "open data", "write code", "safe web",
    "city hospital", "public school", "music theory", "local history", "garden plants", "science museum", "weather service", "travel notes", "river valley farm", "village church", "mountain rescue", "nature reserve", "bird reserve", "primary school",
    "court records", "tax office", "census data", "climate research", "physics lab", "chemistry notes", "biology course", "medical journal", "nursing college", "student union", "college library", "reading club", "chess club", "cycling tours",
    "hiking trails", "national park", "city theatre", "film festival", "jazz radio", "folk music", "poetry review", "short stories", "children books", "cooking school", "bread recipe", "wine valley", "coffee house", "tea garden",
    "software docs", "linux kernel", "python tutorial", "map archive", "star atlas", "space agency", "ocean institute", "animal shelter", "fire department", "water works", "town hall", "post office", "bus timetable", "train museum", "big river tours", "win the race", "real estate law", "money museum", "game theory", "card index", "live concerts",
)
#: The longest word the segmenter knows.
LONGEST = 24
#: Words of any site's URLs; they stand in every training name of either class, so they say nothing.
COMMON = "http https www m blog news example com org net en fr de es html htm php index page article tag id".split()


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (then, up to ``?`` or ``#``); else both empty."""
    rest = F.coalesce(F.regexp_extract(url, "(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, counted in host plus path characters; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Most likely split of a run of letters into words under a unigram model (Viterbi)."""

    def __init__(self, counts: dict[str, int], longest: int = LONGEST, total: int | None = None):
        self.total = (sum(counts.values()) if total is None else total) + 1
        self.score = {w: math.log(n / self.total) for w, n in counts.items() if len(w) <= longest}
        self.longest = longest
        self.known: dict[str, tuple[str, ...]] = {}

    def unknown(self, n: int) -> float:
        """An unknown word is less likely than any known one, and the more so the longer it is."""
        return -math.log(self.total) - 2.0 - 2.5 * n

    def __call__(self, run: str) -> tuple[str, ...]:
        if run in self.known:
            return self.known[run]
        best, back = [0.0], [0]
        for i in range(1, len(run) + 1):
            top, at = -math.inf, i - 1
            for j in range(max(0, i - self.longest), i):
                s = best[j] + self.score.get(run[j:i], self.unknown(i - j))
                if s > top:
                    top, at = s, j
            best.append(top)
            back.append(at)
        words, i = [], len(run)
        while i:
            words.append(run[back[i] : i])
            i = back[i]
        found = tuple(reversed(words))
        if len(run) <= 64:
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[run] = found
        return found


def runs(text: str) -> list[str]:
    """Maximal runs of letters or of digits, lower-cased."""
    import re

    return re.findall(r"[^\W\d_]+|\d+", text.lower())


class NaiveBayes:
    """Multinomial naive Bayes over tokens, add-``alpha`` smoothed; unseen tokens say nothing either way."""

    def __init__(self, classes: dict[str, list[list[str]]], prior: dict[str, float], alpha: float = 0.5):
        vocabulary = {t for texts in classes.values() for x in texts for t in x}
        self.prior = {c: math.log(p) for c, p in prior.items()}
        self.weight: dict[str, dict[str, float]] = {}
        for c, texts in classes.items():
            n = sum(len(x) for x in texts) + alpha * len(vocabulary)
            count: dict[str, int] = {}
            for t in (t for x in texts for t in x):
                count[t] = count.get(t, 0) + 1
            self.weight[c] = {t: math.log((count.get(t, 0) + alpha) / n) for t in vocabulary}

    def __call__(self, tokens: list[str]) -> float:
        """Log odds of "block" against "allow"."""
        odds = self.prior["block"] - self.prior["allow"]
        block, allow = self.weight["block"], self.weight["allow"]
        return odds + sum(block[t] - allow[t] for t in tokens if t in block)


def unigrams(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(w, n): every word of all page titles, counted over every page; of single letters m, a and x."""
    title = F.regexp_extract(pages[html_col], "(?is)<title[^>]*>([^<]*)", 1)
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(title), F.lit("(\\p{L}+)"), 1)).alias("w"))
    return words.filter((F.length("w") > 1) | F.col("w").isin("m", "a", "x")).groupBy("w").agg(F.count("*").alias("n"))


def segmented(urls: DataFrame, counts: DataFrame, seeds: dict[str, int]) -> DataFrame:
    """(host, path, words) of the distinct (host, path) of ``urls``: their runs, split by all of ``counts`` and ``seeds``.

    Each distinct run of letters gets the counts of its own substrings alone, and the table's total:
    no task and no broadcast holds the vocabulary.
    """
    total = (counts.agg(F.sum("n")).first()[0] or 0) + sum(seeds.values())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, p, i, r) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, r in enumerate(runs(f"{h} {p}"))]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], pa.int64() if j == 2 else pa.string()) for j in range(4)], ["host", "path", "at", "run"])

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted({r[i:j] for i in range(len(r)) for j in range(i + 1, min(len(r), i + LONGEST) + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([rid] * len(own), pa.int64()), pa.array(own, pa.string())], ["rid", "w"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for r, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {x["w"]: x["n"] for x in pairs or []}
                for w, n in seeds.items():
                    if w in r:
                        own[w] = own.get(w, 0) + n
                words.append(" ".join(Segmenter(own, total=total)(r)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string())], ["run", "split"])

    listed = stage(urls.select("host", "path").distinct().mapInArrow(cut, "host string, path string, at long, run string"), "runs")
    letters = listed.filter(~F.col("run").rlike("^\\d")).select("run").distinct().select(F.xxhash64("run").alias("rid"), "run")
    known = letters.mapInArrow(substrings, "rid long, w string").join(counts, "w").groupBy("rid").agg(F.collect_list(F.struct("w", "n")).alias("known"))
    found = stage(letters.join(known, "rid", "left").select("run", "known").mapInArrow(split, "run string, split string"), "splits")
    placed = listed.join(found, "run", "left").select("host", "path", F.struct("at", F.coalesce("split", "run").alias("words")).alias("one"))
    return placed.groupBy("host", "path").agg(F.sort_array(F.collect_list("one")).alias("all")).select("host", "path", F.concat_ws(" ", F.col("all.words")).alias("words"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", seed_weight: int = 1, prior: float = 0.2) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_odds, words) of every page.

    The longest fitting rule decides; without one, naive Bayes on the words of host and path does
    ("block" at positive log odds), with ``prior`` as the share of pages to block. A word of the training
    names counts ``seed_weight`` times for each of its names, beside its count in the titles. A null url or one without ``://`` has empty host and path,
    no words, and the class prior's verdict "allow". Repeated rows stay; an empty table gives an
    empty result.
    """
    spark = pages.sparkSession
    counts = stage(unigrams(pages, html_col), "unigrams") if html_col else spark.createDataFrame([], "w string, n long")
    classes = {"block": [x.split() + COMMON for x in BLOCK_NAMES], "allow": [x.split() + COMMON for x in ALLOW_NAMES]}
    seeds: dict[str, int] = {}
    for word in (w for texts in classes.values() for x in texts for w in x):
        if len(word) > 1 or word in ("m", "a", "x"):
            seeds[word] = seeds.get(word, 0) + seed_weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bayes = NaiveBayes(classes, {"block": prior, "allow": 1 - prior})
        for batch in batches:
            odds = [bayes(words.split()) for words in batch["words"].to_pylist()]
            verdict = [v or ("block" if o > 0 else "allow") for v, o in zip(batch["ruled"].to_pylist(), odds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["path"], batch["rule"], pa.array(verdict, pa.string()), pa.array(odds, pa.float64()), batch["words"]], ["page_id", "host", "path", "rule", "verdict", "block_odds", "words"])

    host, path = url_parts(pages[url_col])
    parts = pages.select(pages[id_col].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    split = parts.join(segmented(parts, counts, seeds), ["host", "path"], "left")
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    return split.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), F.coalesce("words", F.lit("")).alias("words")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, block_odds double, words string")


def op9_urls(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op9_urls": op9_urls}
ORACLE_SQL: dict[str, str] = {}
