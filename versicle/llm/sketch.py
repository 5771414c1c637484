"""Document fingerprints: threshold-scaled sketches of byte shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_hexdigest

from ._util import GramHash, shuffle_partitions

#: Bytes in a shingle, and one in how many shingle hashes is retained, whatever the document's length.
SHINGLE, SCALE = 12, 16


class Sketcher:
    """Sketches of texts: every distinct shingle hash below 2**64 / scale, in ascending order.

    Retained hashes keep their 32 leading bits below the threshold. As the threshold is fixed, the
    sketch of a union is the union of the sketches, and containment can be estimated between
    documents of any two sizes. A text shorter than a shingle is one shingle; an empty one has none.
    """

    def __init__(self, shingle: int = SHINGLE, scale: int = SCALE):
        self.grams, self.limit = GramHash(shingle), np.uint64((1 << 64) // scale)
        self.shift = np.uint64(32 - (scale - 1).bit_length())

    def __call__(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        if 0 < len(data) < self.grams.k:
            data = np.concatenate([data, np.zeros(self.grams.k - len(data), np.uint8)])
        hashes = self.grams(data)
        return np.unique((hashes[hashes < self.limit] >> self.shift).astype(np.uint32))

    @staticmethod
    def text(sketch: np.ndarray, whole: bytes) -> str:
        """Hash of the whole text, then the retained hashes: equal texts have equal strings."""
        return f"{xxh64_hexdigest(whole)}:{sketch.astype('>u4').tobytes().hex()}"


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller document's shingles that the other one has; 0 if either sketch is empty."""
    if not len(a) or not len(b):
        return 0.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return float((large[at] == small).mean())


def _likeness(a: np.ndarray, b: np.ndarray, equal: bool) -> float:
    return 1.0 if equal else containment(a, b)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """(doc_id, fingerprint, hashes) of every document; null texts count as empty, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(shingle, scale)
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            found = [sketcher(x) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketcher.text(s, x) for s, x in zip(found, texts, strict=True)]), pa.array([s.tolist() for s in found], pa.list_(pa.int64()))], ["doc_id", "fingerprint", "hashes"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, fingerprint string, hashes array<long>")


def _range_of(column: Column, cuts: list[int]) -> Column:
    """Number of cuts that are greater than the column, as a balanced tree of comparisons."""
    if not cuts:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column >= F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Each document's sketch against that of its edited text and of the next document.

    Documents follow each other by descending id (then by text; null ids last), and the last is
    followed by the first. The edited text is the document's own with its last floor(n / 2) code
    points replaced by the next document's first as many, or by all of them where there are fewer.

    Ids are cut into ranges by quantiles; texts are dealt to their range once, and the first ids of
    each range also to the range before it, so that each task sees all neighbours it needs. A null
    text is empty; an only document is its own next; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    ranges = shuffle_partitions(spark)
    cuts = docs.select("doc_id").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    cuts = sorted({int(x) for x in cuts}, reverse=True)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    at = _range_of(key, cuts)
    heads = [r.asDict() for r in docs.groupBy(at.alias("part")).agg(F.max(key).alias("head")).orderBy("part").collect()]  # one row per range
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    before = spark.createDataFrame([(h["head"], heads[i - 1]["part"]) for i, h in enumerate(heads)], "key long, back int")
    dealt = docs.withColumn("at", at).withColumn("key", key).join(F.broadcast(before), "key", "left")  # as many rows as ranges
    dealt = dealt.select("doc_id", "text", F.posexplode(F.array_compact(F.array("at", "back"))).alias("ghost", "part"))
    dealt = dealt.repartitionById(ranges, "part").sortWithinPartitions("part", "ghost", F.desc_nulls_last("doc_id"), "text").select("part", "ghost", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, rows, held = Sketcher(shingle, scale), [], 0
        own = None  # part, doc_id, text, its bytes and sketch
        over = False  # the first ghost of this range has been met
        for batch in batches:
            for part, ghost, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or own[0] != part:
                    own, over = None, False
                if over:
                    continue
                raw = text.encode()
                now = (part, doc_id, text, raw, sketcher(raw))
                if own is not None:
                    rows.append(compared(sketcher, own, now))
                    held += len(rows[-1][3]) + len(rows[-1][4])
                own, over = now, bool(ghost)
                if held > 8 << 20:
                    yield table(rows)
                    rows, held = [], 0
        if rows:
            yield table(rows)

    def compared(sketcher: Sketcher, own: tuple, after: tuple) -> tuple:
        _, doc_id, text, raw, sketch = own
        half = len(text) // 2
        edited = (text[: len(text) - half] + after[2][:half]).encode()
        other = sketcher(edited)
        return doc_id, len(text), hashlib.sha256(edited).hexdigest(), sketcher.text(sketch, raw), sketcher.text(other, edited), _likeness(sketch, other, raw == edited), _likeness(sketch, after[4], raw == after[3])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return dealt.mapInArrow(run, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op3_sketch(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_sketch": op3_sketch}
ORACLE_SQL: dict[str, str] = {}
