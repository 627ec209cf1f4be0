"""Queries that go through the store: topics made, messages produced, read, committed and resumed.

All events are one topic of four partitions, produced in the order of their ids in two batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..client import Engine, PartitionManager
from ..operators import log, offsets
from ..sources import tables
from ..sources.shared import shared_dir
from ..sources.store import LogStore
from .queries import EV, _fnv

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TOPIC = "events"
#: Even ids are the first batch.
STORED = EV + """, st AS (SELECT event_id, key, value, ts, "partition", row_number() OVER (PARTITION BY "partition" ORDER BY event_id % 2, event_id) - 1 AS "offset" FROM ev)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _filled(spark: SparkSession, d: str) -> tuple[LogStore, DataFrame]:
    """A store with the events, and the answers to both requests."""
    store = LogStore(spark, shared_dir(spark, "store"))
    store.create_topic(TOPIC, 4)
    rows = tables.messages(spark, d).select(F.col("seq").alias("idx"), "key", "value", F.col("timestamp").cast("timestamp").alias("timestamp"))
    even = store.produce(TOPIC, rows.where("idx % 2 = 0"))
    return store, even.unionByName(store.produce(TOPIC, rows.where("idx % 2 <> 0")))


@query(f"""WITH {STORED} SELECT "partition", "offset", key, value, ts AS "timestamp" FROM st""")
def store_roundtrip(spark, d):
    """What a second store on the folder reads."""
    store, _ = _filled(spark, d)
    rows = LogStore(spark, store.path).messages()
    return rows.select("partition", "offset", "key", F.decode("value", "UTF-8").alias("value"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query(f"""WITH {STORED} SELECT event_id AS idx, "partition", "offset", '' AS error FROM st""")
def store_answers(spark, d):
    return _filled(spark, d)[1]


@query(f"""WITH {STORED} SELECT p::INT AS "partition", count("offset") AS size, coalesce(max("offset") + 1, 0) AS next_offset FROM range(5) r(p) LEFT JOIN st ON "partition" = p WHERE p <> 2 GROUP BY 1""")
def store_info(spark, d):
    """After a partition was removed and another one added."""
    store, _ = _filled(spark, d)
    store.remove_partition(TOPIC, 2)
    store.add_partition(TOPIC, 4)
    return store.info(TOPIC).select("partition", "size", "next_offset")


@query(f"""WITH {STORED} SELECT "partition", "offset", key FROM st WHERE "offset" >= CASE WHEN "partition" < 2 THEN 40 ELSE 0 END AND "offset" < CASE WHEN "partition" < 2 THEN 40 ELSE 0 END + 25""")
def store_resume(spark, d):
    """A group commits what it has read of two partitions; a new reader goes on, and reads the others from 0.

    Commits of a group that was deleted don't count."""
    store, _ = _filled(spark, d)
    read = offsets.processing(store.messages().where("partition < 2 and offset < 40"))
    store.commit(read.withColumn("consumer_group", F.lit("g")))
    store.commit(read.select("topic", F.lit(3).alias("partition"), "offset", F.lit("other").alias("consumer_group")).limit(1))
    store.delete_group("other")
    again = LogStore(spark, store.path)
    return offsets.from_committed(again.messages(), again.commits(), "g", 25).select("partition", "offset", "key")


@query(f"""WITH {STORED}, c AS (SELECT "partition", ("offset" - 3) // 1000 AS chunk, count(*) AS messages, max("offset") AS last FROM st WHERE "offset" >= 3 GROUP BY ALL)
SELECT "partition", chunk, messages, last < max(last) OVER (PARTITION BY "partition") AS has_more FROM c""")
def store_stream_chunks(spark, d):
    store, _ = _filled(spark, d)
    return log.chunks(store.messages(), 3, 1000).select("partition", "chunk", "messages", "has_more")


@query(f"""WITH {STORED}, s AS (SELECT event_id, event_id % 2 AS batch, CASE WHEN event_id % 2 = 0 THEN "partition" ELSE ({_fnv("key")} % 6)::INT END AS "partition" FROM ev)
SELECT event_id AS idx, "partition", row_number() OVER (PARTITION BY "partition" ORDER BY batch, event_id) - 1 AS "offset" FROM s""")
def store_scale(spark, d):
    """The second batch comes when the topic has six partitions; what is stored doesn't move."""
    store = LogStore(spark, shared_dir(spark, "store"))
    store.create_topic(TOPIC, 4)
    rows = tables.messages(spark, d).select(F.col("seq").alias("idx"), "key", "value", F.col("timestamp").cast("timestamp").alias("timestamp"))
    even = store.produce(TOPIC, rows.where("idx % 2 = 0"))
    store.scale(TOPIC, 6)
    return even.unionByName(store.produce(TOPIC, rows.where("idx % 2 <> 0"))).select("idx", "partition", "offset")


@query(f"""WITH {STORED}, r AS (SELECT "partition", "offset", event_id, "offset" // 20 AS turn FROM st WHERE "partition" IN (1, 3) AND "offset" < 60)
SELECT "partition", "offset", key, turn FROM r JOIN ev USING (event_id, "partition")""")
def client_managed(spark, d):
    """A group's readers, a new one each turn, read twenty messages of two partitions and commit them."""
    store, _ = _filled(spark, d)
    engine, held = Engine(spark, store.path), []
    for turn in range(3):
        reader = engine.managed_consumer("g")
        for p in (1, 3):
            held += [(p, r.offset, r.key, turn) for r in reader.consume_from_committed(TOPIC, p, 20)]
        reader.close()
    return spark.createDataFrame(held, "partition int, offset long, key string, turn long")


@query(f"""WITH {STORED} SELECT "partition" AS partition_id, count(*) AS message_count, sum(octet_length(key::BLOB) + octet_length(value::BLOB))::BIGINT AS bytes_stored FROM st GROUP BY 1""")
def client_metrics(spark, d):
    store, _ = _filled(spark, d)
    return PartitionManager(Engine(spark, store.path)).metrics(TOPIC).select("partition_id", "message_count", "bytes_stored")
