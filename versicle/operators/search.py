"""Inverted index and search with all words required."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def postings(lines: DataFrame, terms: str, key: str = "line_uid", order: tuple[str, ...] = ("page", "line_number"), size: int = 50) -> DataFrame:
    """(term, part, n_docs, docs): the lines of each term once each, in corpus order, in parts of ``size`` pages.

    A part is numbered by its first page. However frequent a term is, one row holds no more than
    the lines of so many pages. Lines are shuffled, not their terms: those of a part come to one
    task in order, and one part at a time is turned into postings there.
    """
    part = (F.floor((F.col(order[0]) - 1) / size) * size + 1).cast("long")
    own = lines.select(part.alias("part"), F.struct(*order, key).alias("place"), F.col(key).cast("string").alias("key"), F.col(terms).cast("array<string>").alias("terms"))
    dealt = own.filter(F.size("terms") > 0).repartition("part").sortWithinPartitions("part", "place").select("part", F.xxhash64("place").alias("place"), "key", "terms")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for batch in batches:
            parts = batch.column("part").fill_null(NO_PART).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(parts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if open_ and (open_[-1].column("part").fill_null(NO_PART)[0].as_py() != parts[a]):
                    yield from _posted(open_)
                    open_ = []
                if b > a:
                    open_.append(batch.slice(a, b - a))
        if open_:
            yield from _posted(open_)

    found = dealt.mapInArrow(post, "term string, part long, n_docs long, docs array<string>")
    return found.select("term", "part", "n_docs", F.col("docs").cast(f"array<{lines.schema[key].dataType.simpleString()}>").alias("docs"))


#: Stands for a null part, which no page has.
NO_PART = -(2**63)
#: Postings of a batch that goes back to the JVM.
BATCH = 200_000


def _posted(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of one part's lines, which come in order; a line that comes again counts once."""
    table = pa.Table.from_batches(batches)
    place, keys = table["place"].to_numpy(), table["key"].combine_chunks()
    fresh = np.concatenate([[True], place[1:] != place[:-1]])  # equal places lie together
    first = np.flatnonzero(fresh)
    line = np.cumsum(fresh) - 1
    terms = pa.concat_arrays([c for c in table["terms"].chunks])
    flat = terms.flatten().dictionary_encode()
    names = flat.dictionary
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    code = flat.indices.fill_null(len(names)).to_numpy().astype(np.int64)
    of = np.repeat(line, terms.value_lengths().fill_null(0).to_numpy())
    pairs = np.unique(code * len(first) + of)
    code, of = pairs // len(first), pairs % len(first)
    starts = np.searchsorted(code, np.arange(len(names) + (not known.all()) + 1))
    part = table["part"][0].as_py()
    if not known.all():
        names = pa.concat_arrays([names, pa.nulls(1, names.type)])
    begin = 0
    while begin < len(names):
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + BATCH, "right")) - 1)
        docs = keys.take(pa.array(first[of[starts[begin] : starts[end]]]))
        edges = starts[begin : end + 1] - starts[begin]
        columns = [names.slice(begin, end - begin).cast(pa.string()), pa.array([part] * (end - begin), pa.int64()), pa.array(np.diff(edges), pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), docs.cast(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "part", "n_docs", "docs"])
        begin = end


def flat_postings(lines: DataFrame, terms: str, key: str = "line_uid") -> DataFrame:
    """(term, key) rows, the form to keep where a term's list would not fit one row."""
    return lines.select(F.explode(F.array_distinct(terms)).alias("term"), key)


def search(index: DataFrame, lines: DataFrame, query: str, key: str = "line_uid", order: tuple[str, ...] = ("page", "line_number"), most: int = 50) -> DataFrame:
    """Lines with every word of ``query``, first in corpus order, at most ``most``; none for an empty query."""
    words = sorted(set(query.split()))
    hits = index.filter(F.col("term").isin(*words) if words else F.lit(False)).groupBy(key).agg(F.countDistinct("term").alias("n")).filter(F.col("n") == len(words))
    return lines.join(hits.select(key), key, "left_semi").orderBy(*order, key).limit(most)


def documents(lines: DataFrame, matches: DataFrame, key: str = "line_uid", keep: tuple[str, ...] = ("page", "line_number", "author", "text")) -> DataFrame:
    """Search documents: each line with its distinct entities (nested ones aside), in order of name."""
    own = matches.filter(F.col("nested_in").isNull()).groupBy(key).agg(F.array_sort(F.collect_set("entity_id")).alias("e"))
    return lines.select(key, *keep).join(own, key, "left").select(key, *keep, F.coalesce("e", F.array().cast("array<string>")).alias("entities"))
