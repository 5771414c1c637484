"""Structured Streaming: the matcher on a stream of lines, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matching import occurrences


def match_counts(lines: DataFrame, aliases: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes", text_col: str = "text") -> DataFrame:
    """Entity occurrences per tumbling window; the match itself is stateless, state holds one row per open window and entity."""
    found = occurrences(lines.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late).select(time_col, text_col), aliases, text_col)
    return found.groupBy(F.window(time_col, window), "entity_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "entity_id", "n")


def event_counts(events: DataFrame, time_col: str = "ts", key: str = "event_type", window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and mean value per window and key; a batch frame gives the same rows as the finished stream."""
    events = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    base = events.withWatermark(time_col, late) if events.isStreaming else events
    found = base.groupBy(F.window(time_col, window, slide) if slide else F.window(time_col, window), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), key, "n", F.round("total", 4).alias("total"))
