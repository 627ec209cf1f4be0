"""Figures that the load generators report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 10_000


def throughput(messages: DataFrame) -> DataFrame:
    """Messages a second of each topic, over the time between its first and last."""
    ts = F.unix_micros(F.col("timestamp").cast("timestamp"))
    span = (F.max(ts) - F.min(ts)) / 1e6
    return messages.groupBy("topic").agg(F.count("*").alias("messages"), F.round(F.try_divide(F.count("*").cast("double"), F.when(span > 0, span)), 6).alias("per_second"))


def latency(samples: DataFrame, value: str, order: list) -> DataFrame:
    """n, mean of all, and the 99th percentile by rank: of the first 10 000 samples in order,
    ascending, the one at floor(0.99 n). That number of samples is the feature's own."""
    first = samples.orderBy(*order).limit(SAMPLES).select(F.col(value).alias("v"))
    ranked = first.withColumn("_r", F.row_number().over(Window.orderBy("v")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    p99 = ranked.where("_r = least(cast(floor(_n * 0.99) as bigint), _n - 1)").agg(F.max("v").alias("p99"))
    mean = samples.agg(F.count("*").alias("samples"), F.round(F.avg(value), 6).alias("avg_latency"))
    return mean.withColumn("_one", F.lit(1)).join(F.broadcast(p99.withColumn("_one", F.lit(1))), "_one").drop("_one")


def histogram(counts: DataFrame) -> DataFrame:
    """counts (partition, n) with each one's percentage."""
    return counts.withColumn("percent", F.round(F.try_divide(F.col("n") * F.lit(100.0), F.sum("n").over(Window.partitionBy())), 6))


def dispersion(counts: DataFrame) -> DataFrame:
    """The variance of n over the mean, in percent (no root is taken)."""
    return counts.agg(F.round(F.try_divide(F.var_pop("n"), F.when(F.avg("n") != 0, F.avg("n"))) * 100, 6).alias("dispersion_percent"))


def batch_efficiency(produced: Column, producers: int, batch: int) -> Column:
    if batch <= 1:
        return F.lit(100.0)
    return F.least(F.lit(100.0), produced / F.lit(float(producers)) / F.lit(float(batch)) * 100)
