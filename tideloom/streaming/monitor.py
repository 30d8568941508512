"""Streaming monitor of event series: an extension, for the reference has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(id, start, n, mean, sd) by tumbling window and user; later events than the watermark are dropped by the engine.

    events: ts, user_id, value; a stream or a table.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    stats = timed.groupBy(F.col("user_id").alias("id"), F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return stats.select("id", F.col("w.start").alias("start"), "n", "mean", "sd")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(id, start, end, n) of bursts of events no farther apart than `gap`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.col("user_id").alias("id"), F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
