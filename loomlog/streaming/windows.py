"""Event-time windows: extensions, for which the reference has no operator.

``ts`` is a timestamp; a stream needs the watermark to forget old windows and drop late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, keys: list[str], lateness: str | None = None) -> DataFrame:
    return sliding(events, width, width, keys, lateness)


def sliding(events: DataFrame, width: str, every: str, keys: list[str], lateness: str | None = None) -> DataFrame:
    """start, end, keys, events, total (of ``value``) of each window."""
    held = events.withWatermark("ts", lateness) if lateness else events
    counted = held.groupBy(F.window("ts", width, every).alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "events", "total")


def sessions(events: DataFrame, gap: str, keys: list[str], lateness: str | None = None) -> DataFrame:
    """start, end, keys, events of each run of events no further apart than gap."""
    held = events.withWatermark("ts", lateness) if lateness else events
    counted = held.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("events"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "events")
