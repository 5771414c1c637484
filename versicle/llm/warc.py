"""WARC records: reading, and resolution of not-modified revisits by an as-of join."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._util import shuffle_partitions, stage

#: Headers of the stored response that a not-modified answer must not replace: those about the body it
#: does not have, and those of one connection only. Names are compared in lower case.
NOT_MERGED = (
    "content-length", "content-encoding", "content-type", "content-range", "content-md5", "content-language", "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "trailers",
    "transfer-encoding", "upgrade", "proxy-connection",
)
#: Query parameters that name no other page.
TRACKING = "utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid"

RECORD = "record_id string, warc_type string, url string, at timestamp, status int, headers map<string,string>, payload_digest string, payload binary"


def parse_warc(data: bytes) -> Iterator[tuple]:
    """RECORD tuples of a WARC file's bytes, plain or gzipped; header names of HTTP in lower case.

    A record without a usable length ends the file; bodies without an HTTP head keep it empty.
    """
    from datetime import datetime, timezone

    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = _head(stream)
        try:
            body = stream.read(int(head["content-length"]))
        except (KeyError, ValueError):
            return
        status, http, payload = None, {}, body
        if head.get("warc-type") in ("response", "revisit") and body.startswith(b"HTTP/"):
            inner = io.BytesIO(body)
            first = inner.readline().split(b" ", 2)
            status = int(first[1]) if len(first) > 1 and first[1].strip().isdigit() else None
            http, payload = _head(inner), inner.read()
        at = head.get("warc-date")
        when = datetime.fromisoformat(at.replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None) if at else None
        yield head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), when, status, http, head.get("warc-payload-digest"), payload


def _head(stream: io.BytesIO) -> dict[str, str]:
    found: dict[str, str] = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def read_warc(spark, path: str) -> DataFrame:
    """RECORD rows of the WARC files under ``path``, through Spark's own file access."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(RECORD))

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = list(parse_warc(data))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, tracking parameters and a final slash dropped; host in lower case; query sorted."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^({TRACKING})(=|$)"))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of several spellings of one name the last in name order stays."""
    entries = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e))))


def _plain(etag: Column) -> Column:
    """An entity tag without the weak mark: not-modified answers compare weakly."""
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """Each revisit with the latest earlier full response of its canonical URL.

    ``records`` has the RECORD columns (others are ignored). A full response is of type "response"
    with status 200 and a time; a revisit is of type "revisit" or has status 304. The one looked up
    is the latest at an earlier time (among equal times: the greatest record_id); a response at the
    revisit's own time is not earlier. Then ``outcome`` is
    "resolved" if a validator agrees (payload digest if both have one; else ETag, compared weakly;
    else Last-Modified), "unchecked" if there is none to compare, "mismatch" if it disagrees,
    "missing" without an earlier response, for a null time or a null url. Merged headers are the
    response's, with the revisit's put over them but for NOT_MERGED; they and ``payload`` are null
    unless the outcome is "resolved" or "unchecked".

    Returns record_id, url, canonical, at, outcome, response_id, response_at, headers and, if asked
    for, payload. Repeated revisits each give a row; repeated record_ids of responses count once.

    Timelines are cut by ranges of (url, time): each range is one task's, however hot one URL is.
    What reaches a range from before it is the last response of an earlier range: one row per range
    goes to the driver. Bodies take no part in this; they are joined to the result by record_id.
    """
    spark = records.sparkSession
    light = records.select("record_id", "warc_type", "url", "at", "status", _lower_keys(F.coalesce("headers", F.create_map().cast("map<string,string>"))).alias("headers"), "payload_digest")
    is_full = F.coalesce((F.col("warc_type") == "response") & (F.col("status") == 200), F.lit(False))
    is_revisit = F.coalesce((F.col("warc_type") == "revisit") | (F.col("status") == 304), F.lit(False))
    light = light.select("*", canonical_url(F.col("url")).alias("canonical"), is_full.alias("full")).filter(F.col("full") | is_revisit)
    light = light.filter(~F.col("full") | (F.col("at").isNotNull() & F.col("canonical").isNotNull()))
    # at one time, revisits come before responses, which are thus never "earlier" for them
    order = ["canonical", "at", "full", "record_id"]
    cut = light.repartitionByRange(shuffle_partitions(spark), *order).select("*", F.spark_partition_id().alias("part"))
    cut = stage(cut, "timeline")
    carried = F.when(F.col("full"), F.struct("canonical", "at", F.col("record_id").alias("response_id"), "headers", "payload_digest"))
    lasts = cut.filter("full").groupBy("part").agg(F.max_by(carried, F.struct("canonical", "at", "record_id")).alias("last")).orderBy("part").collect()  # one row per range
    parts = [r["part"] for r in cut.select("part").distinct().orderBy("part").collect()]
    reach, now, by_part = [], None, {r["part"]: r["last"] for r in lasts}
    for part in parts:
        if now is not None:
            reach.append((part, now))
        now = by_part.get(part, now)
    carried_type = cut.select(carried.alias("last")).schema["last"].dataType.simpleString()
    reach = spark.createDataFrame(reach, f"part int, reach {carried_type}")
    window = Window.partitionBy("part", "canonical").orderBy("at", "full", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = cut.withColumn("found", F.last(carried, ignorenulls=True).over(window)).filter(~F.col("full"))
    found = found.join(F.broadcast(reach), "part", "left")
    earlier = F.coalesce("found", F.when(F.col("reach.canonical") == F.col("canonical"), F.col("reach")))
    found = found.withColumn("earlier", F.when(F.col("at").isNotNull(), earlier))

    mine, theirs = F.col("headers"), F.col("earlier.headers")
    agree = F.coalesce(
        F.col("payload_digest") == F.col("earlier.payload_digest"), _plain(mine["etag"]) == _plain(theirs["etag"]), mine["last-modified"] == theirs["last-modified"]
    )
    outcome = F.when(F.col("earlier").isNull(), "missing").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("mismatch")
    allowed = F.map_filter(mine, lambda k, _: ~k.isin(*NOT_MERGED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)
    result = found.select("record_id", "url", "canonical", "at", outcome.alias("outcome"), F.col("earlier.response_id").alias("response_id"), F.col("earlier.at").alias("response_at"), merged.alias("merged"))
    good = F.col("outcome").isin("resolved", "unchecked")
    result = result.select("record_id", "url", "canonical", "at", "outcome", "response_id", "response_at", F.when(good, F.col("merged")).alias("headers"))
    if not with_payload:
        return result
    # one body per response: hot responses are split by the join's skew handling, their bodies read once
    bodies = records.filter(is_full & F.col("record_id").isNotNull()).select(F.col("record_id").alias("response_id"), "payload").dropDuplicates(["response_id"])
    joined = result.join(bodies, "response_id", "left")
    return joined.select(*result.columns, F.when(good, F.col("payload")).alias("payload"))


def crawl_of(pages: DataFrame) -> DataFrame:
    """RECORD rows of a crawl of ``pages``: each page fetched in full, then visited twice again.

    The times, validators and answers follow from page_id alone: page p is fetched at p minutes;
    its first revisit, an hour to four days later, is a 304 with the same ETag; the second comes a
    week after the fetch with an ETag that has changed for every seventh page, by Last-Modified for
    every fifth, and without any validator for every eleventh. Pages of one canonical URL share a
    timeline.
    """
    p = F.col("page_id")
    start = F.timestamp_seconds(F.lit(1_700_000_000) + p * 60)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"))
    tag = F.concat(F.lit('"'), F.substring(F.sha2("body", 256), 1, 16), F.lit('"'))
    modified = F.concat(F.lit("Day "), p.cast("string"))
    kinds = F.array(
        F.struct(F.lit(0).alias("visit"), F.lit(0).cast("long").alias("later")), F.struct(F.lit(1).alias("visit"), (F.pmod(p * 7919, F.lit(95)) * 3600 + 3600).alias("later")), F.struct(F.lit(2).alias("visit"), F.lit(604_800).cast("long").alias("later"))
    )
    rows = base.withColumn("tag", tag).select("*", F.explode(kinds).alias("kind"))
    visit = F.col("kind.visit")
    sent = F.when((visit == 2) & (p % 7 == 0), F.lit('"changed"')).when((visit == 2) & ((p % 5 == 0) | (p % 11 == 0)), F.lit(None)).when(visit == 1, F.concat(F.lit("W/"), "tag")).otherwise(F.col("tag"))
    date = F.when((visit < 2) | (p % 11 != 0), modified)
    sends = {
        "ETag": sent, "Last-Modified": date, "Date": F.concat(F.lit("visit "), visit.cast("string")), "Content-Length": F.when(visit == 0, F.length("body").cast("string")).otherwise("0"),
        "Cache-Control": F.when(visit == 0, "max-age=60").otherwise("max-age=600"), "Content-Type": F.when(visit == 0, "text/html"),
    }
    headers = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, sends)), F.array(*sends.values())), lambda _, v: v.isNotNull())
    return rows.select(
        F.concat_ws("-", p, visit).alias("record_id"), F.when(visit == 0, "response").otherwise("revisit").alias("warc_type"), "url", (start + F.make_dt_interval(secs=F.col("kind.later"))).alias("at"), F.when(visit == 0, 200).otherwise(304).alias("status"),
        headers.alias("headers"), F.lit(None).cast("string").alias("payload_digest"), F.when(visit == 0, F.col("body")).alias("payload"),
    )


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Resolved revisits of a crawl of all pages, with digests of the merged headers and the body."""
    found = resolve_revisits(crawl_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    return found.select("record_id", "canonical", "outcome", "response_id", text.alias("headers"), F.sha2("payload", 256).alias("payload_sha256"))


QUERIES = {"op6_warc": op6_warc}
ORACLE_SQL: dict[str, str] = {
    "op6_warc": f"""WITH u AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '(?i)^[a-z][a-z0-9+.-]*://', '') AS rest FROM pages),
c AS (SELECT page_id, html, '"' || substr(sha256(html), 1, 16) || '"' AS tag, 'Day ' || page_id AS day, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
  list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^({TRACKING})(=|$)'))) AS q FROM u),
r AS (SELECT page_id, html, tag, day, CASE WHEN len(q) > 0 THEN base || '?' || array_to_string(q, '&') ELSE base END AS canonical, 1700000000 + page_id * 60 AS t FROM c),
v AS (SELECT page_id, canonical, 1 AS visit, t + (page_id * 7919) % 95 * 3600 + 3600 AS t, 'W/' || tag AS etag, day FROM r
  UNION ALL SELECT page_id, canonical, 2, t + 604800, CASE WHEN page_id % 7 = 0 THEN '"changed"' WHEN page_id % 5 = 0 OR page_id % 11 = 0 THEN NULL ELSE tag END, CASE WHEN page_id % 11 <> 0 THEN day END FROM r),
f AS (SELECT v.page_id, v.canonical, v.visit, v.etag, v.day, arg_max(r.page_id, (r.t, r.page_id || '-0')) AS found FROM v LEFT JOIN r ON r.canonical = v.canonical AND r.t < v.t GROUP BY ALL),
o AS (SELECT f.*, r.html, r.tag, r.day AS old, coalesce(regexp_replace(f.etag, '^W/', '') = r.tag, f.day = r.day) AS agree FROM f LEFT JOIN r ON r.page_id = f.found),
k AS (SELECT *, CASE WHEN found IS NULL THEN 'missing' WHEN agree IS NULL THEN 'unchecked' WHEN agree THEN 'resolved' ELSE 'mismatch' END AS outcome FROM o)
SELECT page_id || '-' || visit AS record_id, canonical, outcome, found || '-0' AS response_id, CASE WHEN outcome IN ('resolved', 'unchecked') THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || octet_length(encode(html)) || chr(10) || 'content-type: text/html' || chr(10) || 'date: visit ' || visit || chr(10) || 'etag: ' || coalesce(etag, tag) || chr(10) || 'last-modified: ' || coalesce(day, old) END AS headers,
CASE WHEN outcome IN ('resolved', 'unchecked') THEN sha256(html) END AS payload_sha256 FROM k"""
}
