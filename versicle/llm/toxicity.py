"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import release_memory, stage, tidy

#: Labelled rows to fit on, at most; parts they are dealt to, so that a row is scored by terms and trees of the others.
FIT_ROWS, FOLDS = 4000, 4
#: Terms to learn from them: so many at most, each in so many toxic rows at least.
LEARNED_TERMS, LEARNED_LEAST = 3000, 3

#: A text of this score or more is predicted toxic.
THRESHOLD = 0.7

#: Common English insults and slurs of contempt.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb dumbass loser losers scum trash garbage worthless pathetic disgusting clown clowns fool fools imbecile cretin jerk jerks bastard bastards bitch ass asshole crap damn "
    "shit shitty bullshit fuck fucking fucker hate hateful ugly filthy vermin pig pigs rat rats creep freak freaks lunatic psycho retard retarded whore slut kill die vile gross repulsive degenerate parasite".split()
)
#: Second-person pronouns of the four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer usted ustedes tú ti tuyo vosotros vuestro".split())
#: Signs that stand in for letters.
LEET = str.maketrans("0134578@$!+|", "oieastbasitl")

CAPITALS = re.compile(r"[A-Z]{3,}")
EDGE = "\"'.,;:?()[]{}<>«»“”‘’…-–—*#%&/\\|=~^_`"

FEATURES = (
    "log_words", "insult_density", "insult_count", "insult_near_you", "you_density", "learned_density", "learned_sum", "learned_max", "learned_count", "obfuscation", "mixed_words",
    "capitals", "capital_words", "exclamation", "question", "punctuation", "digits", "non_ascii", "word_length", "repeated_words",
)


def units(word: str) -> list[str]:
    """A word and its beginnings of four to seven letters, which catch unseen inflections and compounds."""
    return [word] + [f"{word[:n]}*" for n in range(4, 8) if len(word) > n]


def words_of(text: str) -> list[str]:
    return [x for x in (w.strip(EDGE) for w in text.lower().split()) if x]


class WordFacts(dict):
    """word -> weight of its best learned unit, plus 100 for an insult, 200 for a pronoun, 400 for an obfuscated insult, 800 for letters mixed with signs."""

    def __init__(self, learned: dict[str, float], most: int = 250_000):
        super().__init__()
        self.learned, self.most = learned, most

    def __missing__(self, raw: str) -> float:
        word = raw.strip(EDGE + "!")
        value = max((self.learned.get(u, 0.0) for u in units(word)), default=0.0) if word else 0.0
        letters = any(c.isalpha() for c in word)
        if word in INSULTS:
            value += 100
        if word in SECOND_PERSON:
            value += 200
        if letters and not word.isalpha():
            value += 800
            plain = word.translate(LEET)
            if plain != word and re.sub(r"[^a-z]", "", plain) in INSULTS or re.sub(r"[^a-z]", "", word) in INSULTS:
                value += 400
        if len(raw) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[raw] = value
        return value


def features(text: str, facts: WordFacts) -> np.ndarray:
    """The FEATURES of a whole text; all zero for an empty one. Densities are per word or per character."""
    raw = text.encode()
    if not raw:
        return np.zeros(len(FEATURES), np.float32)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.lower().split()
    n = max(1, len(words))
    value = np.fromiter(map(facts.__getitem__, words), np.float64, len(words))
    flags = (value // 100).astype(np.int64)
    weight = value - 100 * flags
    insult, you = flags & 1 > 0, flags & 2 > 0
    hit = insult | (weight > 0) | (flags & 4 > 0)
    near = 0
    if hit.any() and you.any():
        window = np.convolve(you, np.ones(7), "same") if len(you) >= 7 else np.full(len(you), you.sum())
        near = int((window[hit] > 0).sum())
    caps = len(CAPITALS.findall(text)) if count[65:91].sum() > 2 else 0
    chars = len(raw)
    punctuation = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    same = sum(map(eq, words, words[1:]))
    return np.array(
        [
            np.log1p(len(words)), insult.sum() / n, min(insult.sum(), 50), near / n, you.sum() / n, (weight > 0).sum() / n, weight.sum() / n, weight.max(initial=0.0), min((weight > 0).sum(), 50), (flags & 4 > 0).sum() / n, (flags & 8 > 0).sum() / n,
            count[65:91].sum() / chars, caps / n, count[33] / chars, count[63] / chars, punctuation / chars, count[48:58].sum() / chars, count[128:].sum() / chars, chars / n if n < 1e9 else 0.0, same / n,
        ],
        np.float32,
    )


def unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, with, without): in how many toxic and other rows of each fold a unit occurs, as arrays by fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for fold, y, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = {w.strip("!") for w in words_of(text)}
                found.update((2 * fold + y, u) for u in {u for w in words for u in units(w)})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([u for _, u in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["kind", "unit", "n"])

    each = sample.select("fold", "y", "text").mapInArrow(tidy(run), "kind int, unit string, n long")
    own = lambda y: F.array(*(F.coalesce(F.sum(F.when(F.col("kind") == 2 * f + y, F.col("n"))), F.lit(0)) for f in range(FOLDS)))
    return each.groupBy("unit").agg(own(1).alias("with"), own(0).alias("without"))


def learn_terms(counts: DataFrame, sizes: dict[tuple[int, int], int], folds: list[int]) -> dict[str, float]:
    """Units with the highest smoothed log odds of being in a toxic row of the given folds, with those odds: LEARNED_TERMS at most."""
    n1, n0 = (sum(sizes.get((f, y), 0) for f in folds) + 1.0 for y in (1, 0))
    c1, c0 = (sum((F.col(c)[f] for f in folds), F.lit(0)) for c in ("with", "without"))
    found = counts.select("unit", c1.alias("c1"), c0.alias("c0")).filter(F.col("c1") >= LEARNED_LEAST)
    found = found.withColumn("odds", F.ln((F.col("c1") + 0.5) / n1 * n0 / (F.col("c0") + 0.5))).filter("odds > 2.0")
    best = found.orderBy(F.desc(F.col("odds") * F.least("c1", F.lit(20))), "unit").limit(LEARNED_TERMS)
    return {r["unit"]: min(r["odds"], 9.0) for r in best.select("unit", "odds").collect()}


class Boosted:
    """Gradient-boosted regression trees on logistic loss, over features cut into at most 64 bins."""

    def __init__(self, trees: int = 120, depth: int = 3, rate: float = 0.1, least: float = 5.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.least, self.ridge = trees, depth, rate, least, ridge
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, 64)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        size = 2**self.depth
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(size, np.int64), np.full(size, np.inf)
            for level in range(self.depth):
                for k in range(2**level, 2 ** (level + 1)):
                    own = np.flatnonzero(node == k - 2**level)
                    best = self._split(binned[:, own], grad[own], hess[own], edges)
                    if best:
                        feature[k], cut[k] = best[0], edges[best[0]][best[1]]
                node = 2 * node + (x[np.arange(len(y)), feature[2**level + node]] > cut[2**level + node])
            g, h = np.bincount(node, grad, size), np.bincount(node, hess, size)
            leaf = self.rate * g / (h + self.ridge)
            score += leaf[node]
            self.forest.append((feature, cut, leaf))
        return self

    def _split(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, edges: list[np.ndarray]) -> tuple[int, int] | None:
        if len(grad) < 2 * self.least:
            return None
        g_all, h_all = grad.sum(), hess.sum()
        best, gain = None, 1e-6
        for f, e in enumerate(edges):
            if not len(e):
                continue
            g, h, n = (np.cumsum(np.bincount(binned[f], w, len(e) + 1))[:-1] for w in (grad, hess, None))
            ok = (n >= self.least) & (len(grad) - n >= self.least)
            made = np.where(ok, g**2 / (h + self.ridge) + (g_all - g) ** 2 / (h_all - h + self.ridge) - g_all**2 / (h_all + self.ridge), -np.inf)
            k = int(np.argmax(made))
            if made[k] > gain:
                best, gain = (f, k), made[k]
        return best

    def __call__(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.forest:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            score += leaf[node]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best rising map from score to rate (pool adjacent violators), to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # score sum, rate sum, weight
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(s), float(v), 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.02) / (b[2] + 0.04) for b in blocks])


class Model:
    """Learned terms, trees and calibration."""

    def __init__(self):
        self.terms: dict[str, float] = {}
        self.trees: Boosted | None = None
        self.knots = (np.zeros(1), np.zeros(1))

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, terms: dict[str, float]) -> Model:
        """From FEATURES, 0/1 labels and folds of the rows; calibrated on scores by trees of the other folds."""
        out = np.zeros(len(y))
        for k in np.unique(fold):
            rest, own = fold != k, fold == k
            if rest.any():
                out[own] = Boosted().fit(x[rest], y[rest])(x[own])
        self.terms, self.trees, self.knots = terms, Boosted().fit(x, y), isotonic(out, y)
        return self

    def __call__(self, texts: list[str], facts: WordFacts) -> np.ndarray:
        if self.trees is None or not texts:
            return np.zeros(len(texts))
        score = self.trees(np.stack([features(t, facts) for t in texts]))
        at, rate = self.knots
        # a trace of the raw score keeps the order where the calibration is flat
        return np.clip(0.999 * np.interp(score, at, rate) + 0.001 / (1 + np.exp(-score)), 0.0, 1.0)


def held_out(id_column) -> F.Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """A model of the labelled documents that are not held out: of all of them, or of ``rows`` in hash order.

    Null labels and ids and labels without a document are left out before the rows are chosen; a
    document labelled twice counts as toxic if either label says so, and of several texts under one
    id the least counts. Without labels of both kinds the model scores every text 0. Whole texts of
    any length are read in tasks; what reaches the driver are terms and FEATURES.
    """
    key = labels[id_col].cast("long")
    known = labels.filter(key.isNotNull() & labels[label_col].isNotNull() & ~held_out(key)).groupBy(key.alias("doc_id")).agg(F.max(labels[label_col].cast("int")).alias("y"))
    ids = docs.select(docs[id_col].cast("long").alias("doc_id"))
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most `rows` labels are sent
    sample = stage(found.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold"), F.col("y").cast("int").alias("y"), "text").repartition(4 * FOLDS), "labelled")
    sizes = {(r["fold"], r["y"]): r["n"] for r in sample.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    if len({y for _, y in sizes}) < 2:
        return Model()
    counts = stage(unit_counts(sample), "units")
    terms = [learn_terms(counts, sizes, [f for f in range(FOLDS) if f != k]) for k in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = [WordFacts(t) for t in terms]  # a row's terms are learned from the other rows, as they will be for new ones
        for batch in batches:
            own = [features(t, facts[k]).tolist() for k, t in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(own, pa.list_(pa.float32()))], ["doc_id", "fold", "y", "x"])

    made = sample.mapInArrow(tidy(run), "doc_id long, fold int, y int, x array<float>").orderBy("doc_id").collect()  # FEATURES of at most `rows` rows
    x, y, fold = (np.array([r[c] for r in made], t) for c, t in (("x", np.float32), ("y", np.float64), ("fold", np.int64)))
    return Model().fit(x, y, fold, learn_terms(counts, sizes, list(range(FOLDS))))


def scorer(spark: SparkSession, model: Model):
    """A function of a text column: the model's score of each whole text."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))  # size bounded by LEARNED_TERMS and the trees

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = pickle.loads(shared.value)
        facts = WordFacts(fitted.terms)
        for part in texts:
            own = [fitted([x or "" for x in part[i : i + 512]], facts) for i in range(0, len(part), 512)]
            yield pd.Series(np.concatenate(own) if own else [], dtype="float64")
        facts = None
        release_memory()

    return scored


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its whole text alone.

    Null and empty texts get the score of a text without features; held_out is null for a null id.
    """
    scored = scorer(docs.sparkSession, model)
    found = docs.select(docs[id_col].cast("long").alias("doc_id"), scored(docs[text_col]).alias("score"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns as before."""
    return docs.filter(scorer(docs.sparkSession, model)(docs[text_col]) < threshold)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
