"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import stage, work_dir  # noqa: F401

#: From malloc.h (a fixed value).
M_MMAP_THRESHOLD = -3


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs; clashing extra columns go, a null text becomes empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def tidy(run: Callable, rows: int = 512) -> Callable:
    """``run`` (a function of Arrow batches) on slices of at most ``rows`` rows; what its task held goes back to the machine at the end.

    Spark keeps Python workers from task to task, and their allocators keep freed memory; without
    this each operator starts on top of what the ones before it needed. Blocks over 1 MB are
    mapped by themselves, so that freeing one gives it back at once.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c_library("mallopt", M_MMAP_THRESHOLD, 1 << 20)
        yield from run(batch.slice(i, rows) for batch in batches for i in range(0, batch.num_rows, rows))
        release_memory()

    return whole


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """What is run within sends at most ``most`` rows at once to Python, or fewer if the session says so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(most, int(before)) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    c_library("malloc_trim", 0)


def c_library(function: str, *args: int) -> None:
    """Call a function of the GNU C library; nothing where there is another."""
    try:
        getattr(ctypes.CDLL("libc.so.6"), function)(*args)
    except (OSError, AttributeError):
        pass


def raw_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column (null: empty), without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


class HashCache(dict):
    """bytes -> 8 bytes of its XXH3 hash, remembered; emptied when it grows over ``most`` entries."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        from xxhash import xxh3_64_digest

        self.most, self.digest = most, xxh3_64_digest

    def __missing__(self, key: bytes) -> bytes:
        value = self.digest(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class GramHash:
    """64-bit hashes of all ``k``-byte substrings of a buffer, by prefix sums of a polynomial modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, k: int):
        self.k = k
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers), 1 << 14)
            back = pow(self.BASE, -1, 1 << 64)
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.BASE, np.uint64)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, back, np.uint64)]), dtype=np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data) - self.k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.inverse[: len(data)], out=sums[1:])
        return mix64((sums[self.k :] - sums[:n]) * self.powers[:n])
