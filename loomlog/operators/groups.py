"""Consumer groups from a log of join, leave and heartbeat events.

Members are ordered by id, so an assignment is one outcome, and partitions keep
their topic. Topics match as sets of equal length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def members(events: DataFrame) -> DataFrame:
    """group_id, consumer_id, last_heartbeat of those whose last join or leave is a join.

    events: group_id, consumer_id, kind (join, leave, heartbeat), ts, seq."""
    at = F.struct("ts", "seq")
    turn = F.col("kind").isin("join", "leave")
    held = events.groupBy("group_id", "consumer_id").agg(F.max_by("kind", F.when(turn, at)).alias("last"), F.max(F.when(F.col("kind") != "leave", F.col("ts"))).alias("last_heartbeat"))
    return held.where("last = 'join'").select("group_id", "consumer_id", "last_heartbeat")


def inactive(beats: DataFrame, now: Column, timeout_ms: int = 30_000) -> DataFrame:
    """consumer_id, idle_ms of those silent for over twice the timeout (strictly)."""
    idle = (F.unix_micros(now) - F.unix_micros(F.col("last_heartbeat").cast("timestamp"))) / 1000
    return beats.withColumn("idle_ms", idle.cast("long")).where(idle > 2 * timeout_ms)


def assign(member_ids: DataFrame, partitions: DataFrame) -> DataFrame:
    """Round robin in each group: the i-th partition (by topic's place, partition) to member i mod m.

    member_ids: group_id, consumer_id; partitions: group_id, topic_order, topic, partition."""
    own = Window.partitionBy("group_id")
    ranked = member_ids.select("group_id", "consumer_id", (F.row_number().over(own.orderBy("consumer_id")) - 1).alias("_turn"), F.count("*").over(own).alias("_m"))
    sizes = ranked.select("group_id", "_m").distinct()
    dealt = partitions.withColumn("_i", F.row_number().over(own.orderBy("topic_order", "topic", "partition")) - 1).join(sizes, "group_id").withColumn("_turn", F.expr("cast(pmod(_i, _m) as int)"))
    return dealt.join(ranked.drop("_m"), ["group_id", "_turn"]).select("group_id", "consumer_id", "topic", "partition")


def topics_match(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)))


def info(member_ids: DataFrame, partitions: DataFrame, groups: DataFrame) -> DataFrame:
    """State, members and counts of each of ``groups`` (group_id): Empty without members."""
    held = member_ids.groupBy("group_id").agg(F.count("*").alias("member_count"), F.array_join(F.array_sort(F.collect_set("consumer_id")), ",").alias("members"))
    counts = partitions.groupBy("group_id").agg(F.count("*").alias("partition_count"))
    zero = F.lit(0).cast("long")
    return groups.join(held, "group_id", "left").join(counts, "group_id", "left").select(
        "group_id", F.when(F.col("member_count") > 0, "Stable").otherwise("Empty").alias("state"), F.coalesce("member_count", zero).alias("member_count"), F.coalesce("partition_count", zero).alias("partition_count"), F.coalesce("members", F.lit("")).alias("members")
    )


def leaders(leases: DataFrame, now: Column) -> DataFrame:
    """topic, partition, node: the live lease of the least revision leads."""
    return leases.where(F.col("expires") > now).groupBy("topic", "partition").agg(F.min_by("node", "revision").alias("node"))
