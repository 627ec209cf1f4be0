"""Consumers' progress as a table of commits, of which the last one counts.

A commit may move back, so it's the offset of the largest commit_seq, never the largest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def committed(commits: DataFrame) -> DataFrame:
    """consumer_group, topic, partition, offset as they stand; merged before the shuffle."""
    return commits.groupBy("consumer_group", "topic", "partition").agg(F.max_by("offset", "commit_seq").alias("offset"))


def get(commits: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (consumer_group, topic, partition) with the offset, 0 where none was committed."""
    keys = ["consumer_group", "topic", "partition"]
    return wanted.join(committed(commits), keys, "left").withColumn("offset", F.coalesce("offset", F.lit(0).cast("long")))


def of_group(commits: DataFrame, group: str, topic: str) -> DataFrame:
    """partition, offset of one group and topic."""
    return committed(commits.where((F.col("consumer_group") == group) & (F.col("topic") == topic))).select("partition", "offset")


def without_group(commits: DataFrame, group: str) -> DataFrame:
    """What is left after the group is deleted; its name alone, no prefix."""
    return committed(commits.where(F.col("consumer_group") != group))


def from_committed(log: DataFrame, commits: DataFrame, group: str, most: int = 100) -> DataFrame:
    """The next ``most`` messages of each partition for the group.

    Offsets are dense, so a range of offsets is a number of messages and no rank is needed."""
    done = committed(commits.where(F.col("consumer_group") == group)).select("topic", "partition", F.col("offset").alias("_from"))
    rows = log.join(_small(done), ["topic", "partition"], "left").withColumn("_from", F.coalesce("_from", F.lit(0).cast("long")))
    return rows.where((F.col("offset") >= F.col("_from")) & (F.col("offset") < F.col("_from") + most)).drop("_from")


def _small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, as a broadcast table if it has at most ``most`` rows (they are read here, once)."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def processing(consumed: DataFrame) -> DataFrame:
    """The offset after the last one consumed, for each topic and partition."""
    return consumed.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("offset"))


def lag(info: DataFrame, commits: DataFrame, group: str) -> DataFrame:
    """next_offset - committed for each partition (extension: the reference reports none)."""
    done = committed(commits.where(F.col("consumer_group") == group)).select("topic", "partition", F.col("offset").alias("committed"))
    zero = F.lit(0).cast("long")
    return info.join(done, ["topic", "partition"], "left").select("topic", "partition", "next_offset", F.coalesce("committed", zero).alias("committed"), (F.col("next_offset") - F.coalesce("committed", zero)).alias("lag"))
