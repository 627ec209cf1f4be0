"""Queries that run a stream to the end of its input and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import log
from ..sources import tables
from ..sources.shared import shared_dir
from ..streaming import log as streams
from ..streaming import windows
from .queries import LOG, N

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return streams.source(spark, f"{d.rstrip('/')}/events.parquet")


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _routed(events: DataFrame) -> DataFrame:
    return log.routed(tables.event_messages(_timed(events)), N)


@query(f"""WITH {LOG} SELECT topic, "partition", event_id AS seq, "offset" FROM log""")
def stream_assign_offsets(spark, d):
    return streams.finish(streams.assign_offsets(_routed(_events(spark, d))), shared_dir(spark, "assign"))


@query(f"""WITH {LOG} SELECT event_id AS seq, topic, "partition", key FROM log""")
def stream_consume(spark, d):
    return streams.finish(_routed(_events(spark, d)).select("seq", "topic", "partition", "key"), shared_dir(spark, "consume"))


@query(f"""WITH {LOG} SELECT 'g0' AS consumer_group, topic, "partition", max("offset") + 1 AS "offset", 0::BIGINT AS commit_seq FROM log GROUP BY topic, "partition" """)
def stream_commit(spark, d):
    return streams.commit_stream(streams.assign_offsets(_routed(_events(spark, d))), shared_dir(spark, "commit"), "g0")


@query("""WITH b AS (SELECT 'c' || user_id AS consumer_id, max(ts) AS last FROM events WHERE event_type = 'view' GROUP BY 1), n AS (SELECT max(ts) AS now FROM events WHERE event_type = 'view')
SELECT consumer_id, epoch_us(last) // 1000 AS last_heartbeat_ms FROM b, n WHERE epoch_us(now) // 1000 - epoch_us(last) // 1000 > 2 * 86400000""")
def stream_evict(spark, d):
    """Consumers of which the stream's event time says that they were silent for over two days."""
    beats = _timed(_events(spark, d)).where("event_type = 'view'").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("consumer_id"), "ts")
    return streams.finish(streams.evict(beats, 86_400_000), shared_dir(spark, "evict"))


WINDOW = """SELECT {start} AS "start", {start} + INTERVAL {days} DAY AS "end", event_type, count(*) AS events, round(sum(value), 4) AS total FROM {rows} GROUP BY ALL"""


@query(WINDOW.format(start="date_trunc('day', ts)", days=1, rows="events"))
def window_tumbling(spark, d):
    held = windows.tumbling(_timed(_events(spark, d)), "1 day", ["event_type"], "2 days")
    return _plain(streams.finish(held, shared_dir(spark, "tumbling"), "complete"))


@query(WINDOW.format(start="date_trunc('day', ts) - INTERVAL (back) DAY", days=3, rows="events, range(3) b(back)"))
def window_sliding(spark, d):
    held = windows.sliding(_timed(_events(spark, d)), "3 days", "1 day", ["event_type"], "2 days")
    return _plain(streams.finish(held, shared_dir(spark, "sliding"), "complete"))


@query("""WITH a AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 12 HOUR, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM a)
SELECT min(ts) AS "start", max(ts) + INTERVAL 12 HOUR AS "end", user_id, count(*) AS events FROM s GROUP BY user_id, n""")
def window_session(spark, d):
    held = windows.sessions(_timed(tables.table(spark, d, "events")), "12 hours", ["user_id"])
    return held.withColumns({x: F.col(x).cast("timestamp_ntz") for x in ("start", "end")})


@query("""SELECT n_name, count(*) AS events, round(sum(value), 4) AS total FROM events JOIN nation ON user_id % 25 = n_nationkey GROUP BY 1""")
def stream_static_join(spark, d):
    """A stream of events against the table of nations, 25 rows."""
    nation = tables.table(spark, d, "nation").select("n_nationkey", "n_name")
    held = _events(spark, d).join(F.broadcast(nation), F.col("user_id") % 25 == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return streams.finish(held, shared_dir(spark, "static"), "complete").withColumn("total", F.round("total", 4))


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({x: F.col(x).cast("timestamp_ntz") for x in ("start", "end")}).withColumn("total", F.round("total", 4))
