"""Metric logs: append-only streams to JSON files, and running aggregates with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_log(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Starts the sink: each trigger (``save interval``) flushes what has come."""
    writer = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def running_loss(stream: DataFrame, late: str = "2 hours", window: str = "1 hour") -> DataFrame:
    """Mean loss per kind and window of logged time; rows later than ``late`` are left out by the watermark."""
    return stream.withWatermark("logged_at", late).groupBy(F.window("logged_at", window), "kind").agg(F.count("loss").alias("n"), F.avg("loss").alias("loss"))


def validation_loss(parts: DataFrame) -> DataFrame:
    """Mean of all partial (sum, count) of the replicas."""
    return parts.agg((F.sum("loss_sum") / F.sum("loss_count")).alias("loss"), F.sum("loss_count").alias("n"))
