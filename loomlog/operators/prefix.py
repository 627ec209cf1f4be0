"""Numbers in an order, without one task that sorts a whole key.

Rows are counted by (key, bucket), buckets being ordered and narrow; the counts'
running sums, few rows, are joined to row numbers taken within each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPTO = (Window.unboundedPreceding, -1)


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list, out: str, base: Column | None = None) -> DataFrame:
    """``out``: 0, 1, ... for each key by bucket, then order; plus ``base`` if given.

    ``bucket`` must not decrease along ``order``; neither it nor keys may be null."""
    held = df.withColumn("_bucket", bucket)
    counts = held.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(*_UPTO)), F.lit(0))
    counts = counts.select(*keys, "_bucket", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    number = F.col("_before") + F.col("_place") + (F.lit(0) if base is None else base)
    return held.withColumn("_place", place).join(counts, [*keys, "_bucket"]).withColumn(out, number.cast("long")).drop("_bucket", "_place", "_before")


def hour(ts: str) -> Column:
    """The bucket of most queries: the timestamp's hour, as a number that doesn't fall when
    clocks are set back. No timestamp is the first bucket, as nulls come first in an order."""
    return F.coalesce(F.unix_date(F.to_date(ts)) * 24 + F.hour(ts), F.lit(-(1 << 31)))


def part(number: str, rows: int = 1 << 16) -> Column:
    """The bucket of rows that are numbered already, with gaps or without."""
    return F.coalesce(F.floor(F.col(number) / rows), F.lit(-(1 << 63)).cast("long"))
