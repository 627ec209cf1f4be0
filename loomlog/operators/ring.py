"""Consistent hashing: a ring of virtual nodes, looked up by an equi-join.

A ring of n partitions has replicas x n points. Points become intervals of hashes;
intervals are cut at the borders of 256 buckets (top eight bits), so a key finds its own
by bucket equality and a range test. The ring's size is known (points + buckets),
which is what makes its broadcast safe; past ``MOST`` points it's joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import sha1_prefix

REPLICAS, TOP, MOST = 150, 4294967295, 200_000


def vnodes(spark: SparkSession, partitions: Iterable[int], replicas: int = REPLICAS) -> DataFrame:
    """partition, replica, hash of every point; replicas <= 0 means 150."""
    replicas = replicas if replicas > 0 else REPLICAS
    ids = spark.createDataFrame([(int(p),) for p in sorted(set(partitions))], "partition int")
    points = ids.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    return points.withColumn("hash", sha1_prefix(F.concat_ws(":", F.col("partition").cast("string"), F.col("replica").cast("string"))))


def intervals(points: DataFrame) -> DataFrame:
    """bucket, lo, hi, partition: a hash from lo to hi belongs to partition."""
    order = Window.orderBy("hash", "partition")  # the ring's points alone
    ends = points.select("hash", "partition").withColumn("lo", F.coalesce(F.lag("hash").over(order) + 1, F.lit(0).cast("long"))).withColumn("hi", F.col("hash"))
    last = points.agg(F.max("hash").alias("hash"), F.min_by("partition", F.struct("hash", "partition")).alias("partition"))
    tail = last.where("hash is not null").select((F.col("hash") + 1).alias("lo"), F.lit(TOP).cast("long").alias("hi"), "partition")
    every = ends.select("lo", "hi", "partition").unionByName(tail).where("lo <= hi")
    cut = every.withColumn("bucket", F.explode(F.sequence(F.shiftright("lo", 24), F.shiftright("hi", 24))))
    return cut.select(F.col("bucket").cast("int").alias("bucket"), "lo", "hi", "partition")


def route(keys: DataFrame, key: Column, partitions: Iterable[int], replicas: int = REPLICAS, out: str = "partition") -> DataFrame:
    """keys with the partition that owns each; -1 on an empty ring."""
    partitions = sorted(set(partitions))
    ring = intervals(vnodes(keys.sparkSession, partitions, replicas)).withColumnRenamed("partition", "_owner")
    if len(partitions) * max(replicas, 1) <= MOST:
        ring = F.broadcast(ring)
    held = keys.withColumn("_hash", sha1_prefix(key)).withColumn("_slot", F.shiftright("_hash", 24).cast("int"))
    on = (F.col("_slot") == F.col("bucket")) & F.col("_hash").between(F.col("lo"), F.col("hi"))
    return held.join(ring, on, "left").withColumn(out, F.coalesce("_owner", F.lit(-1))).drop("_hash", "_slot", "bucket", "lo", "hi", "_owner")


def load(routed: DataFrame, partitions: Iterable[int]) -> DataFrame:
    """partition, keys: how many rows each partition got, those without any too."""
    ids = routed.sparkSession.createDataFrame([(int(p),) for p in sorted(set(partitions))], "partition int")
    counts = routed.groupBy("partition").agg(F.count("*").alias("keys"))
    return ids.join(counts, "partition", "left").select("partition", F.coalesce("keys", F.lit(0).cast("long")).alias("keys"))


def spread(loads: DataFrame) -> DataFrame:
    """Total, least, most and mean of a load, and (most - least) / mean in percent, null without keys."""
    mean = F.avg("keys")
    return loads.agg(
        F.sum("keys").alias("total_keys"), F.count("*").alias("partitions"), F.min("keys").alias("min_keys"), F.max("keys").alias("max_keys"),
        mean.alias("avg_keys"), F.round(F.try_divide((F.max("keys") - F.min("keys")) * F.lit(100.0), F.when(mean != 0, mean)), 6).alias("spread_percent"),
    )
