"""A key-value table with leases, as a log of puts and deletes.

The last write of a key counts; a key whose lease has run out is gone. A node leads
what its key names if it was the first to create the key while it was free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state(writes: DataFrame, now: Column) -> DataFrame:
    """key, value, revision of the live keys; writes: key, value (null: deleted), revision, expires (null: never)."""
    last = writes.groupBy("key").agg(F.max_by(F.struct("value", "expires"), "revision").alias("x"), F.max("revision").alias("revision"))
    live = F.col("x.value").isNotNull() & F.coalesce(F.col("x.expires") > now, F.lit(True))
    return last.where(live).select("key", F.col("x.value").alias("value"), "revision")


def listed(held: DataFrame, prefix: str) -> DataFrame:
    """The keys that begin with prefix, taken as it is: no pattern."""
    return held.where(F.col("key").startswith(prefix))


def elections(writes: DataFrame) -> DataFrame:
    """key, value, revision of the puts that found the key free: never written, deleted, or with a
    lease that had run out by then; writes: as above, all of them applied, with ``at``, the time of the write."""
    order = Window.partitionBy("key").orderBy("revision")
    before = F.lag(F.struct("value", "expires")).over(order)
    free = before.isNull() | before["value"].isNull() | F.coalesce(before["expires"] <= F.col("at"), F.lit(False))
    return writes.withColumn("_free", free).where(F.col("value").isNotNull() & F.col("_free")).select("key", "value", "revision")


def leases(events: DataFrame) -> DataFrame:
    """lease, expires of the leases that weren't revoked; events: lease, kind (grant, keepalive, revoke),
    at, revision, ttl_s. A lease lives on from its last keepalive, unless that came too late."""
    order = Window.partitionBy("lease").orderBy("revision")
    own = events.where("kind <> 'revoke'")
    until = F.col("at") + F.make_dt_interval(secs=F.col("ttl_s").cast("decimal(18,6)"))
    # a keepalive after the lease's end, and all after it, find nothing
    late = (F.col("kind") == "keepalive") & (F.lag(until).over(order) <= F.col("at"))
    dead = F.sum(F.coalesce(late, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = own.withColumn("_until", until).withColumn("_dead", dead).where("_dead = 0").groupBy("lease").agg(F.max("_until").alias("expires"))
    return held.join(events.where("kind = 'revoke'").select("lease").distinct(), "lease", "left_anti")


def watch(writes: DataFrame, prefix: str, after: int) -> DataFrame:
    """revision, key, kind (put, delete), value of the writes under prefix after a revision, as a watcher is sent them.

    A filter alone, so it holds for a stream of writes as well."""
    rows = writes.where(F.col("key").startswith(prefix) & (F.col("revision") > after))
    return rows.select("revision", "key", F.when(F.col("value").isNull(), "delete").otherwise("put").alias("kind"), "value")


def creations(writes: DataFrame) -> DataFrame:
    """key, value, revision of the puts that found the key free: never written or deleted."""
    before = F.lag("value").over(Window.partitionBy("key").orderBy("revision"))
    return writes.withColumn("_before", before).where(F.col("value").isNotNull() & F.col("_before").isNull()).select("key", "value", "revision")
