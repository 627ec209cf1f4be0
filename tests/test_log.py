"""The log, its store and its clients."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from loomlog.client import BatchProducer, Engine, GroupCoordinator, HealthMonitor, PartitionManager, read_range
from loomlog.operators import batching, groups, kv, log, offsets
from loomlog.sources.store import LogStore, StoreError

MESSAGES = "topic string, partition int, key string, timestamp timestamp, seq long"


def _rows(spark, n, topic="t", partition=0):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(topic, partition, f"key-{k}", at + dt.timedelta(hours=7 * k), k) for k in range(n)], MESSAGES)


def test_reads(spark):
    rows = log.assign_offsets(_rows(spark, 5))
    assert [r.key for r in log.read(rows, "t", 0, 0, 3).collect()] == ["key-0", "key-1", "key-2"]
    assert [r.offset for r in log.read(rows, "t", 0, 3, 5).collect()] == [3, 4]
    assert tuple(log.has_more(rows, "t", 0, 0, 3).first()) == (3, True)
    assert tuple(log.has_more(rows, "t", 0, 3, 5).first()) == (2, False)
    for offset in (-1, 5, 10):
        assert log.read(rows, "t", 0, offset, 1).count() == 0
        assert tuple(log.has_more(rows, "t", 0, offset, 1).first()) == (0, False)
    assert tuple(log.has_more(rows, "t", 0, 0, 0).first()) == (0, True)
    for f in (log.read, log.has_more):
        with pytest.raises(ValueError):
            f(rows, "t", 0, 0, -1)


def test_offsets_are_dense_under_skew(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.range(3000).select(F.lit("t").alias("topic"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("partition"), (F.lit(at) + F.make_dt_interval(secs=(F.col("id") * 997 % 700000).cast("decimal(18,6)"))).alias("timestamp"), F.col("id").alias("seq"))
    got = log.assign_offsets(rows).groupBy("partition").agg(F.min("offset"), F.max("offset"), F.countDistinct("offset")).collect()
    assert {tuple(r) for r in got} == {(0, 0, 1999, 2000), (1, 0, 999, 1000)}


def test_store_roundtrip_and_errors(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    with Engine(spark, path).store as store:
        for n, want in ((4, 4), (0, 1), (-5, 1)):
            store.create_topic(f"t{n}", n)
            assert store.num_partitions(f"t{n}") == want
        with pytest.raises(StoreError, match="topic t4 already exists"):
            store.create_topic("t4")
        with pytest.raises(StoreError, match="topic none does not exist"):
            store.info("none")
        assert store.topics() == ["t-5", "t0", "t4"]
    with pytest.raises(StoreError, match="storage is closed"):
        store.topics()
    engine = Engine(spark, path)
    producer = engine.producer()
    done = producer.send("t4", [(f"key-{k}", b"v%d" % k) for k in range(30)]).collect()
    assert [r.idx for r in done] == list(range(30)) and all(r.error == "" for r in done)
    assert done[0].partition == 1 and done[3].partition == 0
    again = producer.send("t4", [("key-0", b"more")]).first()
    assert again.partition == 1 and again.offset == sum(r.partition == 1 for r in done)
    # a second store on the same folder sees all of it, in the order of numbers
    back = LogStore(spark, path)
    held = back.consume("t4", 1, 0).collect()
    assert [r.offset for r in held] == list(range(len(held))) and held[-1].value == b"more"
    assert sum(r["size"] for r in back.info("t4").collect()) == 31
    back.remove_partition("t4", 2)
    with pytest.raises(StoreError, match="partition 2 does not exist"):
        back.consume("t4", 2, 0)
    bad = producer.send("t4", [("key-1", b""), ("key-0", b"")]).collect()
    assert [(r.partition, r.error) for r in bad] == [(-1, "partition 2 does not exist"), (1, "")]
    assert producer.metrics() == {"messages_sent": 32, "errors": 1}
    with pytest.raises(StoreError, match="topic name is required"):
        producer.send("", [("a", b"")])
    with pytest.raises(StoreError, match="at least one message is required"):
        producer.send("t4", [])
    rows, more = read_range(engine, "t4", 1, 0, 2)
    assert rows.count() == 2 and more
    producer.send("made", [("a", b"1")])
    assert back.num_partitions("made") == 4


def test_many_partitions_and_reads_in_number_order(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/many")
    store.create_topic("t", 12)
    rows = spark.range(200).select(F.col("id").alias("idx"), F.lit("").alias("key"), F.lit(b"x").alias("value"), F.lit(None).cast("timestamp").alias("timestamp"))
    store.produce("t", rows)
    assert [r.offset for r in store.consume("t", 0, 2, 100).collect()] == list(range(2, 102))
    assert store.consume("t", 9, 0).count() == 0


def test_managed_consumer(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/managed")
    engine.producer().send("t", [("", b"%d" % k) for k in range(10)])
    reader = engine.managed_consumer("g")
    assert [r.offset for r in reader.consume_from_committed("t", 0, 4)] == [0, 1, 2, 3]
    reader.commit_processing()
    assert engine.store.committed("g", "t", 0) == 4 and engine.store.committed("g:x", "t", 0) == 0
    assert [r.offset for r in engine.managed_consumer("g").consume_from_committed("t", 0, 3)] == [4, 5, 6]
    reader.commit("t", 0, 1)
    assert engine.store.committed("g", "t", 0) == 1
    engine.managed_consumer("g:x").commit("t", 0, 9)
    engine.store.delete_group("g")
    assert engine.store.committed("g", "t", 0) == 0 and engine.store.committed("g:x", "t", 0) == 9
    seen = []
    assert engine.consumer().consume_stream("t", 0, 0, seen.append, 4) == 10 and len(seen) == 10
    assert engine.health()["metrics"]["messages_consumed"] == "10"
    memory = LogStore(spark, f"file://{tmp_path}/memory", persistent=False)
    assert memory.committed("g", "t", 0) == 0
    with pytest.raises(StoreError, match="offset management not available"):
        memory.commit(spark.createDataFrame([("g", "t", 0, 1)], "consumer_group string, topic string, partition int, offset long"))


def test_commits_move_back(spark):
    rows = spark.createDataFrame([("g", "t", 0, 5, 1), ("g", "t", 0, 3, 2), ("h", "t", 0, 7, 1)], "consumer_group string, topic string, partition int, offset long, commit_seq long")
    assert {tuple(r) for r in offsets.committed(rows).collect()} == {("g", "t", 0, 3), ("h", "t", 0, 7)}


def test_partition_manager(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/pm")
    manager = PartitionManager(engine)
    manager.create("t", 2)
    with pytest.raises(StoreError, match="already has partitions"):
        manager.create("t", 2)
    assert manager.partition_of("t", "key-6") == 1
    with pytest.raises(StoreError, match="scaling down"):
        manager.scale("t", 1)
    with pytest.raises(StoreError, match="must be positive"):
        manager.scale("t", 0)
    assert manager.scale("t", 4) == "Successfully scaled topic t from 2 to 4 partitions"
    assert manager.partition_of("t", "key-9") == 3
    engine.producer().send("t", [("", b"abc")])
    assert [(r.partition_id, r.message_count, r.bytes_stored) for r in manager.metrics("t").collect()] == [(0, 1, 3), (1, 0, 0), (2, 0, 0), (3, 0, 0)]
    with pytest.raises(StoreError, match="metrics not found for partition 9"):
        manager.metrics("t", 9)
    assert manager.rebalance("t") == ("Rebalanced 4 partitions for topic t", dict.fromkeys(range(4), "localhost"))
    assert manager.stats() == {"topics": 1, "partitions": 4, "rebalances": 1, "metrics": 4}
    monitor = HealthMonitor()
    monitor.register_store(engine.store)
    assert monitor.health()["overall"] == "healthy"
    monitor.register("x", lambda: ("degraded", {}))
    assert monitor.health()["overall"] == "degraded"
    monitor.register("y", lambda: 1 / 0)
    assert monitor.health()["overall"] == "unhealthy"


def test_group_coordinator():
    now = [0.0]
    c = GroupCoordinator(lambda: now[0])
    c.set_topic_partitions("t", [0, 1, 2, 3])
    c.set_topic_partitions("u", [0, 1])
    c.join("b", "g", ["t", "u"], 100)
    c.join("a", "g", ["u", "t"], 100)
    with pytest.raises(StoreError, match="don't match"):
        c.join("c", "g", ["t", "t"])
    every = c.assignment("a") + c.assignment("b")
    assert sorted(every) == [("t", 0), ("t", 1), ("t", 2), ("t", 3), ("u", 0), ("u", 1)]
    assert c.assignment("a") == [("t", 0), ("t", 2), ("u", 0)]
    now[0] = 0.2
    assert c.evict() == []
    c.heartbeat("a")
    now[0] = 0.3
    assert c.evict() == ["b"] and len(c.assignment("a")) == 6
    assert c.info("g")["state"] == "Stable"
    c.leave("a")
    assert c.info("g") == {"group_id": "g", "state": "Empty", "members": [], "topics": ["t", "u"], "partition_count": 6}
    for call, text in ((lambda: c.leave("z"), "consumer z not found"), (lambda: c.info("z"), "group z not found"), (lambda: c.join("", "g", ["t"]), "consumer_id is required")):
        with pytest.raises(StoreError, match=text):
            call()


def test_assignment_deals_round_robin(spark):
    members = spark.createDataFrame([("g", x) for x in "cab"], "group_id string, consumer_id string")
    partitions = spark.range(8).select(F.lit("g").alias("group_id"), F.lit(0).alias("topic_order"), F.lit("t").alias("topic"), F.col("id").cast("int").alias("partition"))
    got = {}
    for r in groups.assign(members, partitions).orderBy("partition").collect():
        got.setdefault(r.consumer_id, []).append(r.partition)
    assert got == {"a": [0, 3, 6], "b": [1, 4, 7], "c": [2, 5]}


def test_batch_producer():
    sent, naps = [], []
    now = [0.0]
    p = BatchProducer(lambda t, m: sent.append((t, len(m))), max_messages=3, clock=lambda: now[0], sleep=naps.append)
    for k in range(4):
        p.add("t", f"k{k}", b"v")
    assert sent == [("t", 3)] and p.metrics()["active_batches"] == 1
    now[0] = 0.1
    p.flush_stale()
    assert sent[-1] == ("t", 1)
    big = BatchProducer(lambda t, m: sent.append((t, len(m))), max_bytes=4)
    big.add("u", "", b"123456")
    big.add("u", "", b"1")
    big.flush()
    assert sent[-2:] == [("u", 1), ("u", 1)]
    with pytest.raises(StoreError, match="topic name cannot be empty"):
        p.add("", "k", b"")

    def fail(*_):
        raise OSError

    q = BatchProducer(fail, retries=3, sleep=naps.append)
    q.add("t", "k", b"v")
    with pytest.raises(OSError):
        q.flush()
    assert naps == [0.01, 0.02, 0.04] and q.metrics() == {"errors": 1, "active_batches": 1}


def test_batches_by_bytes_equal_a_plain_fold(spark):
    sizes = [1, 5, 3, 9, 20, 1, 1, 1, 1, 1, 1, 7, 4, 4, 4]
    rows = spark.createDataFrame([(t, dt.datetime(2024, 1, 1, k % 24), k, n) for t in "ab" for k, n in enumerate(sizes)], "topic string, timestamp timestamp, seq long, size long")
    want, count, size = [], 0, 0
    for n in sizes:
        if count and (count >= 4 or size + n > 10):
            want.append((count, size))
            count = size = 0
        count, size = count + 1, size + n
    want.append((count, size))
    for topic in "ab":
        got = [(r.messages, r.bytes) for r in batching.by_bytes(rows, 4, 10).where(F.col("topic") == topic).orderBy("batch").collect()]
        assert got == want
    assert batching.by_bytes(rows.where("false")).count() == 0


def test_messages_without_a_time_keep_their_offsets(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("t", 0, f"k{k}", None if k % 3 else at, k) for k in range(9)], MESSAGES)
    assert {r.seq: r.offset for r in log.assign_offsets(rows).collect()} == {1: 0, 2: 1, 4: 2, 5: 3, 7: 4, 8: 5, 0: 6, 3: 7, 6: 8}
    assert log.produce_results(rows.withColumn("idx", F.col("seq")), [0]).count() == 9
    sized = rows.withColumn("size", F.lit(1))
    assert sum(r.messages for r in batching.by_count(sized, 4).collect()) == 9


def test_offsets_are_in_the_order_of_input(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/order")
    at = dt.datetime(2024, 1, 1)
    rows = [(k, "", b"%d" % k, at - dt.timedelta(days=k)) for k in range(20)] + [(20, None, None, None)]
    given = spark.createDataFrame(rows, "idx long, key string, value binary, timestamp timestamp").repartition(3)
    assert [(r.idx, r.offset) for r in store.produce("t", given).collect()] == [(k, k) for k in range(21)]
    held = store.consume("t", 0, 0).collect()
    assert [r.value for r in held] == [b"%d" % k for k in range(20)] + [b""] and held[-1].timestamp is not None


def test_next_offsets_survive_a_writer_that_died(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/died")
    send = lambda n: store.produce("t", spark.range(n).selectExpr("id as idx", "'' as key", "cast('v' as binary) as value", "cast(null as timestamp) as timestamp"))
    send(5)
    store._put_next = lambda *_: None  # messages written, and then no more
    send(3)
    again = LogStore(spark, store.path)
    again.produce("t", spark.range(1).selectExpr("id as idx", "'' as key", "cast('v' as binary) as value", "cast(null as timestamp) as timestamp"))
    assert [r.offset for r in again.consume("t", 0, 0).collect()] == list(range(9))
    again.remove_partition("t", 0)
    again.add_partition("t", 0)
    again.produce("t", spark.range(2).selectExpr("id as idx", "'' as key", "cast('v' as binary) as value", "cast(null as timestamp) as timestamp"))
    assert [r.offset for r in again.consume("t", 0, 0).collect()] == [0, 1]


def test_a_hot_partition_is_written_by_many_tasks(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.produce("t", spark.range(4000).selectExpr("id as idx", "'' as key", "cast('v' as binary) as value", "cast(null as timestamp) as timestamp"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = store.messages().where("partition = 0").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1 and store.messages().agg(F.countDistinct("offset"), F.max("offset")).first() == (4000, 3999)


def test_deleted_groups_may_commit_again(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/groups")
    commit = lambda g, n: store.commit(spark.createDataFrame([(g, "t", 0, n)], "consumer_group string, topic string, partition int, offset long"))
    commit("g", 5), commit("h", 6), store.delete_group("g")
    assert (store.committed("g", "t", 0), store.committed("h", "t", 0)) == (0, 6)
    commit("g", 2)
    assert store.committed("g", "t", 0) == 2 and store.commits().count() == 2


def test_elections_after_a_leases_end(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("k", "a", 1, at(0), at(2)), ("k", "a", 2, at(1), at(3)), ("k", "b", 3, at(2), at(4)), ("k", "c", 4, at(4), at(6)), ("k", None, 5, at(5), None), ("k", "d", 6, at(5), None), ("k", "e", 7, at(99), at(100))]
    writes = spark.createDataFrame(rows, "key string, value string, revision long, at timestamp, expires timestamp")
    assert [(r.value, r.revision) for r in kv.elections(writes).orderBy("revision").collect()] == [("a", 1), ("c", 4), ("d", 6)]
    assert [(r.revision, r.kind) for r in kv.watch(writes, "k", 3).orderBy("revision").collect()] == [(4, "put"), (5, "delete"), (6, "put"), (7, "put")]
    events = [(1, "grant", at(0), 1, 3600), (1, "keepalive", at(0.5), 2, 3600), (1, "keepalive", at(2), 3, 3600), (2, "grant", at(0), 4, 60), (2, "revoke", at(0.1), 5, 60)]
    held = kv.leases(spark.createDataFrame(events, "lease long, kind string, at timestamp, revision long, ttl_s int")).collect()
    assert [(r.lease, r.expires) for r in held] == [(1, at(1.5))]


def test_auto_commit_follow_and_metrics(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/auto")
    engine.producer().send("t", [("", b"%d" % k) for k in range(6)])
    reader = engine.managed_consumer("g", auto_commit=True, interval_s=0.05)
    reader.consume_from_committed("t", 0, 4)
    for _ in range(300):
        if reader.committed_count:
            break
        time.sleep(0.1)
    assert engine.store.committed("g", "t", 0) == 4
    reader.consume_from("t", 0, 4, 2)
    reader.close()
    assert engine.store.committed("g", "t", 0) == 6
    with pytest.raises(StoreError):
        reader.consume_from("t", 9, 0)
    assert reader.metrics() == {"messages_received": 6, "offsets_committed": 2, "errors": 1}
    seen, consumer = [], engine.consumer()

    def take(row):
        seen.append(row.offset)
        if row.offset == 5:
            engine.producer().send("t", [("", b"more")])

    assert consumer.follow("t", 0, 2, take, lambda: len(seen) >= 5, 2) == 7 and seen == [2, 3, 4, 5, 6]
    assert consumer.metrics() == {"messages_received": 5, "errors": 0}
    consumer.close()
    with pytest.raises(StoreError, match="consumer is closed"):
        consumer.consume("t", 0, 0)


def test_stale_batches_go_out_by_themselves():
    sent = []
    p = BatchProducer(lambda t, m: sent.append((t, len(m))), timeout_s=0.02).start()
    p.add("t", "k", b"v")
    for _ in range(200):
        if sent:
            break
        time.sleep(0.01)
    assert sent == [("t", 1)]
    p.timeout_s = 60
    p.add("t", "k", b"v")
    p.close()
    assert sent == [("t", 1), ("t", 1)] and p.ticker is None


def test_health_checks_have_a_timeout_and_an_interval():
    monitor = HealthMonitor(interval_s=0.02, timeout_s=0.05)
    monitor.register("slow", lambda: time.sleep(1))
    assert monitor.health()["components"]["slow"][0] == "unhealthy"
    monitor.checks = {"good": lambda: ("healthy", {})}
    monitor.start()
    for _ in range(200):
        if monitor.last["overall"] == "healthy":
            break
        time.sleep(0.01)
    monitor.stop()
    assert monitor.last["overall"] == "healthy"


def test_batches_by_bytes_of_many_messages(spark):
    sizes = [(k * 7919) % 23 for k in range(30_000)]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "seq long, size long").selectExpr("'t' as topic", "timestamp'2024-01-01' as timestamp", "*")
    want, count, size = [], 0, 0
    for n in sizes:
        if count and (count >= 9 or size + n > 60):
            want.append((count, size))
            count = size = 0
        count, size = count + 1, size + n
    want.append((count, size))
    assert [(r.messages, r.bytes) for r in batching.by_bytes(rows, 9, 60).orderBy("batch").collect()] == want
