"""The log: routes, offsets, reads.

Offsets are dense from 0 for each topic and partition, in the order of (timestamp, seq).
Reads filter on topic, partition and offset, which reach the scan as partition and
row-group filters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv_partition, message_bytes
from ..schema import AUTO_MESSAGES
from . import prefix


def routed(messages: DataFrame, n: int = 4) -> DataFrame:
    """messages with ``partition`` by FNV-1a of the key; n <= 0 means 1. No key is the empty one."""
    return messages.withColumn("partition", fnv_partition(F.coalesce("key", F.lit("")), n))


def assign_offsets(messages: DataFrame, base: Column | None = None) -> DataFrame:
    """messages (topic, partition, timestamp, seq, ...) with ``offset``."""
    return prefix.numbered(messages, ["topic", "partition"], prefix.hour("timestamp"), ["timestamp", "seq"], "offset", base)


def read(log: DataFrame, topic: str, partition: int, offset: int, most: int = AUTO_MESSAGES) -> DataFrame:
    """Up to ``most`` messages from ``offset`` on, in order. Before 0 or past the end: none."""
    if most < 0:
        raise ValueError("max_messages must not be negative")
    rows = log.where((F.col("topic") == topic) & (F.col("partition") == partition))
    if offset < 0:
        return rows.where("false")
    return rows.where(F.col("offset") >= offset).orderBy("offset").limit(most)


def has_more(log: DataFrame, topic: str, partition: int, offset: int, most: int) -> DataFrame:
    """One row: returned (messages of this read) and has_more. False if offset is out of range."""
    if most < 0:
        raise ValueError("max_messages must not be negative")
    rows = log.where((F.col("topic") == topic) & (F.col("partition") == partition))
    size = F.count("*")
    inside = (F.lit(offset) >= 0) & (F.lit(offset) < size)
    end = F.least(F.lit(offset + most).cast("long"), size)
    return rows.agg(F.when(inside, end - offset).otherwise(F.lit(0)).cast("long").alias("returned"), F.when(inside, end < size).otherwise(False).alias("has_more"))


def chunks(log: DataFrame, offset: int, most: int = AUTO_MESSAGES) -> DataFrame:
    """The batches that a stream of each partition sends from ``offset`` on."""
    most = most if most > 0 else AUTO_MESSAGES
    rows = log.where(F.col("offset") >= max(offset, 0)).withColumn("chunk", F.floor((F.col("offset") - offset) / most))
    sent = rows.groupBy("topic", "partition", "chunk").agg(F.count("*").alias("messages"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))
    ends = rows.groupBy("topic", "partition").agg(F.max("offset").alias("_end"))
    return sent.join(ends, ["topic", "partition"]).withColumn("has_more", F.col("last_offset") < F.col("_end")).drop("_end")


def info(log: DataFrame, partitions: DataFrame) -> DataFrame:
    """Size and next offset of every partition (topic, partition), empty ones too."""
    held = log.groupBy("topic", "partition").agg(F.count("*").alias("size"), F.max("offset").alias("last"))
    zero = F.lit(0).cast("long")
    return partitions.join(held, ["topic", "partition"], "left").select("topic", "partition", F.coalesce("size", zero).alias("size"), F.coalesce(F.col("last") + 1, zero).alias("next_offset"))


def produce_results(messages: DataFrame, live: list[int]) -> DataFrame:
    """idx, partition, offset, error for each message (idx, ...) of a log in its order; a message for a
    partition that isn't live gets -1, -1 and the error, and the others go on."""
    return _answered(messages, live, assign_offsets).select("idx", "partition", "offset", "error")


def appended(messages: DataFrame, live: list[int], next_offsets: dict[int, int]) -> DataFrame:
    """messages (idx, ...) with offset and error as a producer's request is answered: in the
    order of idx, from each live partition's next offset on."""
    base = F.lit(0)
    for p, n in next_offsets.items():
        base = F.when(F.col("partition") == p, F.lit(n)).otherwise(base)
    return _answered(messages, live, lambda rows: prefix.numbered(rows, ["topic", "partition"], prefix.part("idx"), ["idx"], "offset", base))


def _answered(messages: DataFrame, live: list[int], number: Callable[[DataFrame], DataFrame]) -> DataFrame:
    alive = F.col("partition").isin(list(live)) if live else F.lit(False)
    done = number(messages.where(alive)).withColumn("error", F.lit(""))
    error = F.format_string("partition %d does not exist", "partition")
    failed = messages.where(~alive).withColumns({"error": error, "offset": F.lit(-1).cast("long")}).withColumn("partition", F.lit(-1))
    return done.unionByName(failed)


def metrics(log: DataFrame) -> DataFrame:
    """Messages, bytes and last activity of each partition."""
    return log.groupBy("partition").agg(F.count("*").alias("message_count"), F.sum(message_bytes(F.col("key"), F.col("value"))).alias("bytes_stored"), F.max("timestamp").alias("last_activity"))
