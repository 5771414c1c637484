"""Queries on event windows: the batch form of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.matcher import event_counts


def event_windows(spark, sf_dir: str):
    """Tumbling windows of an hour; the same operator runs on a stream with a watermark."""
    found = event_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return found.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


QUERIES = {"event_windows": event_windows}
ORACLE_SQL = {"event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"}
