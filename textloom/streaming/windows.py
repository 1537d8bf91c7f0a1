"""Streaming forms: event-time metrics with a watermark, first writer per key, capture sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def metric_windows(events: DataFrame, at: str, group: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and group; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")


def first_of_key(requests: DataFrame, at: str, key: list[str], late: str = "15 minutes") -> DataFrame:
    """The first request of each key; state older than the watermark goes, as an expired mapping does."""
    return requests.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def capture(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows to JSON lines, each exactly once, until the input is used up."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
