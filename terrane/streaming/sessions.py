"""Streams of trace events: windowed counts and sessions with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream gets its watermark, on a time with a zone; a table stays as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by type and window of event time; works on a stream and on a table alike."""
    rows = _timed(events, late)
    return rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events with no pause of ``gap`` or more."""
    rows = _timed(events, late)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
