"""Messages from the test tables.

events: topic 'ev-' and the event's type, key 'user-' and the user's id, value the
properties' bytes, time ``ts``, order (ts, event_id). orders: topic 'orders', key 'order-'
and the order's key, order (o_orderdate, o_orderkey).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_messages(events: DataFrame) -> DataFrame:
    """topic, key, value, timestamp, seq."""
    return events.select(
        F.concat(F.lit("ev-"), F.coalesce("event_type", F.lit(""))).alias("topic"), F.coalesce(F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.lit("")).alias("key"),
        F.encode(F.coalesce("props", F.lit("")), "UTF-8").alias("value"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"),
    )


def order_messages(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.lit("orders").alias("topic"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("key"),
        F.encode(F.col("o_orderstatus"), "UTF-8").alias("value"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderkey").alias("seq"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_messages(table(spark, sf_dir, "events"))
