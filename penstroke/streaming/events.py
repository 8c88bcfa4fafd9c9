"""Streams: rates of events by window, and the state of a revision loop by session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by window of event time; the same plan runs on a table and on a stream, where rows later than
    `late` are dropped and state is bounded by it."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no gap longer than `gap`."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
