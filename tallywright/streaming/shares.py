"""Shares of categories in windows of event time, late rows within the watermark included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """window, category, n of a stream (or table) with ts and category; state goes once the watermark passes."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "category").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "category", "n")


def window_shares(counts: DataFrame) -> DataFrame:
    """Share of each category in its window; on finished counts."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("start")))


def run(events: DataFrame, name: str, checkpoint: str):
    """Append each finished window's counts to a memory table."""
    return window_counts(events).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
