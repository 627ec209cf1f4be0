"""One query for each operator of the log, with the SQL it's held against.

Figures that depend on the time of the run (uptime) are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, hashing, names
from ..operators import batching, groups, kv, log, offsets, ring, stats
from ..sources import tables

N = 4
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# SQL that several queries begin with. The keys are ASCII.
def _fnv(key: str) -> str:
    return f"list_reduce(list_concat([2166136261::BIGINT], list_transform(range(1, length({key}) + 1), lambda i: ascii(substr({key}, i, 1))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


EV = f"""ev AS (SELECT event_id, ts, 'ev-' || event_type AS topic, 'user-' || user_id AS key, props AS value, ({_fnv("'user-' || user_id")} % 4)::INT AS "partition" FROM events)"""
LOG = EV + """, log AS (SELECT *, row_number() OVER (PARTITION BY topic, "partition" ORDER BY ts, event_id) - 1 AS "offset" FROM ev)"""
VN = """vn AS (SELECT ('0x' || substr(sha1(p || ':' || i), 1, 8))::BIGINT AS h, p::INT AS p, i::INT AS i FROM range({n}) a(p), range(150) b(i))"""


def _ring_of(n: int, keys: str, name: str = "r", key: str = "k") -> str:
    """CTEs: ``name`` has the rows of keys with ``p``, the owner in a ring of n."""
    return f"""vn_{name} AS (SELECT ('0x' || substr(sha1(p || ':' || i), 1, 8))::BIGINT AS h, p::INT AS p FROM range({n}) a(p), range(150) b(i)),
    {name} AS (SELECT x.*, coalesce(v.p, (SELECT arg_min(p, h) FROM vn_{name})) AS p FROM (SELECT *, ('0x' || substr(sha1({key}), 1, 8))::BIGINT AS s FROM {keys}) x ASOF LEFT JOIN vn_{name} v ON x.s <= v.h)"""


CUSTOMERS = "ck AS (SELECT c_custkey, 'customer-' || c_custkey AS k FROM customer)"


def routed(spark: SparkSession, d: str) -> DataFrame:
    return log.routed(tables.messages(spark, d), N)


def logged(spark: SparkSession, d: str) -> DataFrame:
    return log.assign_offsets(routed(spark, d))


def customers(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("k"))


def live(spark: SparkSession, d: str) -> DataFrame:
    """topic, partition of all topics of the event log."""
    topics = tables.messages(spark, d).select("topic").distinct()
    return topics.withColumn("partition", F.explode(F.sequence(F.lit(0), F.lit(N - 1))))


# -- routing


@query(f"""WITH {EV} SELECT "partition" AS partition_id, count(*) AS message_count, sum(octet_length(key::BLOB) + octet_length(value::BLOB))::BIGINT AS bytes_stored, max(ts) AS last_activity FROM ev GROUP BY 1""")
def partition_metrics(spark, d):
    return log.metrics(routed(spark, d)).withColumnRenamed("partition", "partition_id")


@query(f"""SELECT event_id, 'user-' || user_id AS key, {_fnv("'user-' || user_id")} AS hash, ({_fnv("'user-' || user_id")} % 4)::INT AS "partition" FROM events""")
def route_fnv(spark, d):
    return routed(spark, d).select(F.col("seq").alias("event_id"), "key", hashing.fnv1a32(F.col("key")).alias("hash"), "partition")


@query(f"""WITH {CUSTOMERS} SELECT c_custkey, ('0x' || substr(sha1(k), 1, 8))::BIGINT AS hash FROM ck""")
def ring_hash(spark, d):
    return customers(spark, d).select("c_custkey", hashing.sha1_prefix(F.col("k")).alias("hash"))


@query(f"""WITH {VN.format(n=4)} SELECT p AS "partition", i AS replica, h AS hash FROM vn""")
def ring_vnodes(spark, d):
    return ring.vnodes(spark, range(N))


@query(f"""WITH k AS (SELECT event_id, 'user-' || user_id AS k FROM events), {_ring_of(4, "k")} SELECT event_id, p AS "partition" FROM r""")
def ring_route(spark, d):
    return ring.route(tables.messages(spark, d).select(F.col("seq").alias("event_id"), "key"), F.col("key"), range(N)).select("event_id", "partition")


@query(f"""WITH {CUSTOMERS}, {_ring_of(8, "ck")} SELECT a.p::INT AS "partition", count(r.p) AS keys FROM range(8) a(p) LEFT JOIN r ON r.p = a.p GROUP BY 1""")
def ring_load(spark, d):
    return ring.load(ring.route(customers(spark, d), F.col("k"), range(8)), range(8))


@query(f"""WITH {CUSTOMERS}, {_ring_of(8, "ck")}, l AS (SELECT a.p, count(r.p) AS keys FROM range(8) a(p) LEFT JOIN r ON r.p = a.p GROUP BY 1)
SELECT sum(keys)::BIGINT AS total_keys, count(*) AS partitions, min(keys) AS min_keys, max(keys) AS max_keys, avg(keys) AS avg_keys, round((max(keys) - min(keys)) * 100.0::DOUBLE / nullif(avg(keys), 0), 6) AS spread_percent FROM l""")
def ring_stats(spark, d):
    return ring.spread(ring_load(spark, d))


@query(f"""WITH {CUSTOMERS}, {_ring_of(4, "ck")},
vn_q AS (SELECT h, p FROM vn_r WHERE p <> 2), q AS (SELECT x.c_custkey, coalesce(v.p, (SELECT arg_min(p, h) FROM vn_q)) AS p FROM (SELECT *, ('0x' || substr(sha1(k), 1, 8))::BIGINT AS s FROM ck) x ASOF LEFT JOIN vn_q v ON x.s <= v.h)
SELECT r.p AS from_partition, q.p AS to_partition, count(*) AS keys FROM r JOIN q USING (c_custkey) GROUP BY 1, 2""")
def ring_remove_move(spark, d):
    """Keys by owner before and after partition 2 leaves: only its keys move."""
    before = ring.route(customers(spark, d), F.col("k"), range(N), out="from_partition")
    after = ring.route(before, F.col("k"), [p for p in range(N) if p != 2], out="to_partition")
    return after.groupBy("from_partition", "to_partition").agg(F.count("*").alias("keys"))


@query(f"""WITH {CUSTOMERS}, {_ring_of(4, "ck", "a")}, {_ring_of(8, "ck", "b")}
SELECT 'fnv' AS route, count(*) AS keys, count(*) FILTER ({_fnv("k")} % 4 <> {_fnv("k")} % 8) AS moved FROM ck
UNION ALL SELECT 'ring', count(*), count(*) FILTER (a.p <> b.p) FROM a JOIN b USING (c_custkey)""")
def scale_moved_keys(spark, d):
    """Keys that another partition owns after four partitions became eight."""
    both = ring.route(ring.route(customers(spark, d), F.col("k"), range(4), out="old"), F.col("k"), range(8), out="new")
    k = F.col("k")
    held = both.select(F.explode(F.array(F.struct(F.lit("fnv").alias("route"), (hashing.fnv_partition(k, 4) != hashing.fnv_partition(k, 8)).alias("m")), F.struct(F.lit("ring").alias("route"), (F.col("old") != F.col("new")).alias("m")))).alias("x"))
    return held.groupBy(F.col("x.route").alias("route")).agg(F.count("*").alias("keys"), F.count_if("x.m").alias("moved"))


@query("""SELECT o_orderkey, lower(lpad(hex(o_orderkey), 16, '0')) AS cell, o_orderkey AS decoded, 0::BIGINT AS short_cell FROM orders""")
def offset_codec(spark, d):
    cell = codec.encode_offset(F.col("o_orderkey"))
    return tables.table(spark, d, "orders").select("o_orderkey", F.lower(F.hex(cell)).alias("cell"), codec.decode_offset(cell).alias("decoded"), codec.decode_offset(F.substring(cell, 1, 4)).alias("short_cell"))


@query("""SELECT code::INT AS code, coalesce(['Stable', 'Rebalancing', 'Empty', 'Dead'][code + 1], 'Unknown') AS group_state, coalesce(['Active', 'Inactive', 'Rebalancing', 'Leaving'][code + 1], 'Unknown') AS consumer_state FROM (SELECT unnest([0, 1, 2, 3, 4, 99]) AS code)""")
def state_names(spark, d):
    codes = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4, 99)], "code int")
    return codes.select("code", names.group_state(F.col("code")).alias("group_state"), names.consumer_state(F.col("code")).alias("consumer_state"))


# -- the log


@query(f"""WITH {LOG} SELECT event_id, topic, "partition", "offset" FROM log""")
def assign_offsets(spark, d):
    return logged(spark, d).select(F.col("seq").alias("event_id"), "topic", "partition", "offset")


@query(f"""WITH {EV}, z AS (SELECT event_id, topic, "partition", CASE WHEN event_id % 7 <> 0 THEN ts END AS ts FROM ev)
SELECT event_id, topic, "partition", row_number() OVER (PARTITION BY topic, "partition" ORDER BY ts NULLS FIRST, event_id) - 1 AS "offset" FROM z""")
def assign_offsets_nulls(spark, d):
    """Every seventh message has no time: these come first."""
    rows = routed(spark, d).withColumn("timestamp", F.when(F.col("seq") % 7 != 0, F.col("timestamp")))
    return log.assign_offsets(rows).select(F.col("seq").alias("event_id"), "topic", "partition", "offset")


@query(f"""WITH o AS (SELECT o_orderkey, o_orderdate, ({_fnv("'order-' || o_orderkey")} % 4)::INT AS "partition" FROM orders)
SELECT o_orderkey, "partition", row_number() OVER (PARTITION BY "partition" ORDER BY o_orderdate, o_orderkey) - 1 AS "offset" FROM o""")
def order_offsets(spark, d):
    """The topic of orders: many keys, one topic."""
    rows = log.assign_offsets(log.routed(tables.order_messages(tables.table(spark, d, "orders")), N))
    return rows.select(F.col("seq").alias("o_orderkey"), "partition", "offset")


@query(f"""WITH {LOG} SELECT event_id AS idx, "partition", "offset", '' AS error FROM log""")
def produce_results(spark, d):
    return log.produce_results(routed(spark, d).withColumn("idx", F.col("seq")), [*range(N)])


@query(f"""WITH {LOG} SELECT event_id AS idx, CASE WHEN "partition" = 2 THEN -1 ELSE "partition" END AS "partition", CASE WHEN "partition" = 2 THEN -1 ELSE "offset" END AS "offset", CASE WHEN "partition" = 2 THEN 'partition 2 does not exist' ELSE '' END AS error FROM log""")
def produce_after_remove(spark, d):
    return log.produce_results(routed(spark, d).withColumn("idx", F.col("seq")), [0, 1, 3])


@query(f"""WITH {LOG} SELECT topic, "partition", "offset", key, value, ts AS "timestamp" FROM log WHERE topic = 'ev-click' AND "partition" = 1 AND "offset" >= 10 AND "offset" < 60""")
def consume_batch(spark, d):
    return log.read(logged(spark, d), "ev-click", 1, 10, 50).select("topic", "partition", "offset", "key", F.decode("value", "UTF-8").alias("value"), "timestamp")


@query(f"""WITH {LOG}, c AS (SELECT count(*) AS n FROM log WHERE topic = 'ev-click' AND "partition" = 1)
SELECT o AS start, CASE WHEN o >= 0 AND o < n THEN least(o + 50, n) - o ELSE 0 END AS returned, CASE WHEN o >= 0 AND o < n THEN least(o + 50, n) < n ELSE false END AS has_more FROM c, (SELECT unnest([-1, 0, 10, 100000000])::BIGINT AS o)""")
def consume_has_more(spark, d):
    rows = logged(spark, d)
    found = [log.has_more(rows, "ev-click", 1, o, 50).select(F.lit(o).cast("long").alias("start"), "returned", "has_more") for o in (-1, 0, 10, 100_000_000)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(f"""WITH {LOG}, c AS (SELECT topic, "partition", ("offset" - 5) // 100 AS chunk, count(*) AS messages, min("offset") AS first_offset, max("offset") AS last_offset FROM log WHERE "offset" >= 5 GROUP BY ALL)
SELECT *, last_offset < max(last_offset) OVER (PARTITION BY topic, "partition") AS has_more FROM c""")
def consume_stream_chunks(spark, d):
    return log.chunks(logged(spark, d), 5)


@query("""SELECT DISTINCT 'ev-' || event_type AS topic FROM events UNION SELECT 'orders'""")
def list_topics(spark, d):
    return tables.messages(spark, d).select("topic").distinct().unionByName(spark.createDataFrame([("orders",)], "topic string"))


@query(f"""WITH {LOG}, t AS (SELECT DISTINCT topic FROM ev UNION ALL SELECT 'ev-none'), p AS (SELECT topic, p::INT AS "partition" FROM t, range(4) r(p))
SELECT p.topic, p."partition", count(l.topic) AS size, coalesce(max("offset") + 1, 0) AS next_offset FROM p LEFT JOIN log l ON l.topic = p.topic AND l."partition" = p."partition" GROUP BY 1, 2""")
def topic_info(spark, d):
    """Sizes and next offsets; the topic 'ev-none' has no messages."""
    none = spark.range(N).select(F.lit("ev-none").alias("topic"), F.col("id").cast("int").alias("partition"))
    return log.info(logged(spark, d), live(spark, d).unionByName(none))


@query(f"""WITH {LOG} SELECT event_id, '{{"key":"' || key || '","value":"' || to_base64(value::BLOB) || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '","offset":' || "offset" || '}}' AS record FROM log""")
def persisted_json(spark, d):
    return logged(spark, d).select(F.col("seq").alias("event_id"), codec.persisted_json(F.col("key"), F.col("value"), F.col("timestamp"), F.col("offset")).alias("record"))


@query(f"""WITH {LOG} SELECT event_id, key, value, "offset" FROM log WHERE event_id % 5 <> 0""")
def read_persisted_json(spark, d):
    """Records read back; every fifth is cut short and left out as corrupt."""
    rows = persisted_json(spark, d).withColumn("record", F.when(F.col("event_id") % 5 == 0, F.left("record", F.lit(20))).otherwise(F.col("record")))
    held = rows.withColumn("m", codec.read_persisted_json(F.col("record"))).where("m is not null")
    return held.select("event_id", F.col("m.key").alias("key"), F.decode("m.value", "UTF-8").alias("value"), F.col("m.offset").alias("offset"))


@query(f"""WITH {LOG} SELECT event_id, format('msg:{{}}:{{}}:{{}}', topic, "partition", "offset") AS message_key, format('offset:{{}}:{{}}', topic, "partition") AS offset_key FROM log""")
def storage_keys(spark, d):
    t, p, o = F.col("topic"), F.col("partition"), F.col("offset")
    return logged(spark, d).select(F.col("seq").alias("event_id"), codec.message_key(t, p, o).alias("message_key"), codec.offset_key(t, p).alias("offset_key"))


@query(f"""WITH {LOG} SELECT event_id, topic || '-' || "partition" AS metric_key, '/leader/' || topic || '/' || "partition" AS leader_path, 'key-' || "partition" || '-' || "offset" AS load_key FROM log""")
def name_keys(spark, d):
    t, p = F.col("topic"), F.col("partition")
    return logged(spark, d).select(F.col("seq").alias("event_id"), names.metric_key(t, p).alias("metric_key"), names.leader_path(t, p).alias("leader_path"), names.load_key(p, F.col("offset")).alias("load_key"))


# -- metrics and health


@query(f"""WITH {EV} SELECT "partition" AS id, count(*) AS message_count, sum(octet_length(key::BLOB) + octet_length(value::BLOB))::BIGINT AS bytes_stored, max(ts) AS last_activity, 'localhost' AS leader FROM ev GROUP BY 1""")
def list_partitions(spark, d):
    return log.metrics(routed(spark, d)).withColumnRenamed("partition", "id").withColumn("leader", F.lit("localhost"))


@query("""SELECT count(DISTINCT event_type) AS topics, (count(DISTINCT event_type) * 4)::BIGINT AS partitions, 0::BIGINT AS rebalances, (count(DISTINCT event_type) * 4)::BIGINT AS metrics FROM events""")
def manager_stats(spark, d):
    return live(spark, d).agg(F.countDistinct("topic").alias("topics"), F.count("*").alias("partitions"), F.lit(0).cast("long").alias("rebalances"), F.count("*").alias("metrics"))


@query("""SELECT 'messages_produced' AS metric, count(*) AS value FROM events UNION ALL SELECT 'messages_consumed', count(*) FILTER (event_type = 'view') FROM events
UNION ALL SELECT 'active_consumers', count(DISTINCT user_id % 7) FROM events UNION ALL SELECT 'topics_count', count(DISTINCT event_type) FROM events""")
def health_metrics(spark, d):
    one = tables.table(spark, d, "events").agg(F.count("*").alias("messages_produced"), F.count_if(F.col("event_type") == "view").alias("messages_consumed"), F.countDistinct(F.col("user_id") % 7).alias("active_consumers"), F.countDistinct("event_type").alias("topics_count"))
    return one.unpivot([], ["messages_produced", "messages_consumed", "active_consumers", "topics_count"], "metric", "value")


@query("""WITH c AS (SELECT user_id % 11 AS node, CASE WHEN avg(value) > 60 THEN 'unhealthy' WHEN avg(value) > 50 THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY 1)
SELECT count(*) AS components, CASE WHEN bool_or(status = 'unhealthy') THEN 'unhealthy' WHEN bool_or(status = 'degraded') THEN 'degraded' ELSE 'healthy' END AS overall FROM c""")
def overall_health(spark, d):
    mean = F.avg("value")
    checks = tables.table(spark, d, "events").groupBy(F.col("user_id") % 11).agg(F.when(mean > 60, "unhealthy").when(mean > 50, "degraded").otherwise("healthy").alias("status"))
    worst = F.when(F.bool_or(F.col("status") == "unhealthy"), "unhealthy").when(F.bool_or(F.col("status") == "degraded"), "degraded").otherwise("healthy")
    return checks.agg(F.count("*").alias("components"), worst.alias("overall"))


@query("""WITH t AS (SELECT DISTINCT 'ev-' || event_type AS topic FROM events) SELECT topic, p::INT AS "partition", 'localhost' AS node, 'Rebalanced 4 partitions for topic ' || topic AS message FROM t, range(4) r(p)""")
def rebalance_assignments(spark, d):
    n = F.count("*").over(Window.partitionBy("topic"))
    return live(spark, d).select("topic", "partition", F.lit("localhost").alias("node"), F.format_string("Rebalanced %d partitions for topic %s", n, "topic").alias("message"))


@query(f"""WITH {EV} SELECT count(*) FILTER ("partition" <> 2) AS messages_sent, count(*) FILTER ("partition" = 2) AS errors FROM ev""")
def producer_metrics(spark, d):
    return produce_after_remove(spark, d).agg(F.count_if(F.col("error") == "").alias("messages_sent"), F.count_if(F.col("error") != "").alias("errors"))


# -- offsets: a click commits its own offset for the group of its user


COMMITS = LOG + """, commits AS (SELECT 'g' || (substr(key, 6)::BIGINT % 3) AS consumer_group, topic, "partition", "offset", (event_id * 7919) % 1000003 AS commit_seq FROM log WHERE topic = 'ev-click'),
last AS (SELECT consumer_group, topic, "partition", arg_max("offset", commit_seq) AS "offset" FROM commits GROUP BY 1, 2, 3)"""


def _commits(rows: DataFrame) -> DataFrame:
    """Commit numbers aren't in the order of offsets, so some commits move back."""
    group = F.concat(F.lit("g"), (F.expr("cast(substring(key, 6) as bigint)") % 3).cast("string"))
    return rows.where("topic = 'ev-click'").select(group.alias("consumer_group"), "topic", "partition", "offset", (F.col("seq") * 7919 % 1000003).alias("commit_seq"))


@query(f"""WITH {COMMITS} SELECT * FROM last""")
def committed_offsets(spark, d):
    return offsets.committed(_commits(logged(spark, d)))


@query(f"""WITH {COMMITS}, w AS (SELECT 'g' || g AS consumer_group, 'ev-click' AS topic, p::INT AS "partition" FROM range(5) a(g), range(4) b(p)) SELECT w.*, coalesce(l."offset", 0) AS "offset" FROM w LEFT JOIN last l USING (consumer_group, topic, "partition")""")
def get_offset_default(spark, d):
    wanted = spark.range(20).select(F.concat(F.lit("g"), F.expr("cast(id div 4 as string)")).alias("consumer_group"), F.lit("ev-click").alias("topic"), (F.col("id") % 4).cast("int").alias("partition"))
    return offsets.get(_commits(logged(spark, d)), wanted)


@query(f"""WITH {COMMITS} SELECT "partition", "offset" FROM last WHERE consumer_group = 'g1' AND topic = 'ev-click'""")
def all_offsets(spark, d):
    return offsets.of_group(_commits(logged(spark, d)), "g1", "ev-click")


@query(f"""WITH {COMMITS} SELECT * FROM last WHERE consumer_group <> 'g1'""")
def delete_group(spark, d):
    return offsets.without_group(_commits(logged(spark, d)), "g1")


@query(f"""WITH {COMMITS} SELECT l.topic, l."partition", l."offset", l.event_id FROM log l LEFT JOIN (SELECT * FROM last WHERE consumer_group = 'g0') c ON c.topic = l.topic AND c."partition" = l."partition" WHERE l."offset" >= coalesce(c."offset", 0) AND l."offset" < coalesce(c."offset", 0) + 20""")
def consume_from_committed(spark, d):
    rows = logged(spark, d)
    return offsets.from_committed(rows, _commits(rows), "g0", 20).select("topic", "partition", "offset", F.col("seq").alias("event_id"))


@query(f"""WITH {LOG} SELECT topic, "partition", max("offset") + 1 AS "offset" FROM log WHERE "offset" < 100 GROUP BY 1, 2""")
def processing_offsets(spark, d):
    return offsets.processing(logged(spark, d).where("offset < 100"))


@query(f"""WITH {COMMITS}, i AS (SELECT topic, "partition", count(*) AS next_offset FROM log GROUP BY 1, 2) SELECT i.*, coalesce(c."offset", 0) AS committed, next_offset - coalesce(c."offset", 0) AS lag FROM i LEFT JOIN (SELECT * FROM last WHERE consumer_group = 'g0') c USING (topic, "partition")""")
def consumer_lag(spark, d):
    rows = logged(spark, d)
    return offsets.lag(log.info(rows, live(spark, d)), _commits(rows), "g0")


# -- groups: signups join, errors leave, other events are heartbeats


MEMBERS = """me AS (SELECT 'c' || lpad((user_id % 17)::VARCHAR, 2, '0') AS consumer_id, 'grp' || (user_id % 17 % 3) AS group_id, CASE event_type WHEN 'signup' THEN 'join' WHEN 'error' THEN 'leave' ELSE 'heartbeat' END AS kind, ts, event_id FROM events),
mem AS (SELECT group_id, consumer_id, max(ts) FILTER (kind <> 'leave') AS last_heartbeat FROM me GROUP BY 1, 2 HAVING arg_max(kind, (ts, event_id)) FILTER (kind <> 'heartbeat') = 'join'),
grp AS (SELECT DISTINCT group_id FROM me),
parts AS (SELECT group_id, t AS topic_order, ['ev-view', 'ev-click'][t + 1] AS topic, p::INT AS "partition" FROM grp, range(2) a(t), range(4) b(p))"""


def _member_events(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("user_id") % 17
    kind = F.when(F.col("event_type") == "signup", "join").when(F.col("event_type") == "error", "leave").otherwise("heartbeat")
    return tables.table(spark, d, "events").select(F.concat(F.lit("grp"), (number % 3).cast("string")).alias("group_id"), F.concat(F.lit("c"), F.lpad(number.cast("string"), 2, "0")).alias("consumer_id"), kind.alias("kind"), "ts", F.col("event_id").alias("seq"))


def _group_partitions(events: DataFrame) -> DataFrame:
    topics = F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("ev-view").alias("t")), F.struct(F.lit(1).alias("o"), F.lit("ev-click").alias("t"))))
    rows = events.select("group_id").distinct().withColumn("x", topics).withColumn("partition", F.explode(F.sequence(F.lit(0), F.lit(N - 1))))
    return rows.select("group_id", F.col("x.o").alias("topic_order"), F.col("x.t").alias("topic"), "partition")


@query(f"""WITH {MEMBERS} SELECT group_id, consumer_id, last_heartbeat, 'Active' AS state FROM mem""")
def group_members(spark, d):
    return groups.members(_member_events(spark, d)).withColumn("state", F.lit("Active"))


@query("""SELECT id, CASE id WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS matches FROM range(6) t(id)""")
def topics_match(spark, d):
    pairs = [(0, ["a", "b"], ["a", "b"]), (1, ["a", "b"], ["b", "a"]), (2, ["a", "b"], ["a"]), (3, ["a", "b"], ["a", "a"]), (4, ["a", "a"], ["a", "b"]), (5, [], [])]
    return spark.createDataFrame(pairs, "id long, a array<string>, b array<string>").select("id", groups.topics_match(F.col("a"), F.col("b")).alias("matches"))


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), t AS (SELECT user_id, list(event_type) AS topics FROM e WHERE n <= 2 GROUP BY 1)
SELECT a.user_id, len(a.topics) = len(b.topics) AND list_sort(list_distinct(a.topics)) = list_sort(list_distinct(b.topics)) AS matches FROM t a JOIN t b ON b.user_id = a.user_id + 1""")
def topics_match_users(spark, d):
    """Each user's first two event types against the next user's: as many, and the same ones."""
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) <= 2
    topics = tables.table(spark, d, "events").withColumn("first", first).where("first").groupBy("user_id").agg(F.collect_list("event_type").alias("topics"))
    other = topics.select((F.col("user_id") - 1).alias("user_id"), F.col("topics").alias("others"))
    return topics.join(other, "user_id").select("user_id", groups.topics_match(F.col("topics"), F.col("others")).alias("matches"))


@query(f"""WITH {MEMBERS}, a AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY consumer_id) - 1 AS rm, count(*) OVER (PARTITION BY group_id) AS m FROM mem),
b AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY topic_order, "partition") - 1 AS rp FROM parts)
SELECT b.group_id, consumer_id, topic, "partition" FROM b JOIN a ON a.group_id = b.group_id AND rp % m = rm""")
def group_assignment(spark, d):
    events = _member_events(spark, d)
    return groups.assign(groups.members(events), _group_partitions(events))


@query("""WITH b AS (SELECT 'c' || user_id AS consumer_id, max(ts) AS last_heartbeat FROM events WHERE event_type = 'view' GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT consumer_id, ((epoch_us(now) - epoch_us(last_heartbeat)) // 1000)::BIGINT AS idle_ms FROM b, n WHERE epoch_us(now) - epoch_us(last_heartbeat) > 2 * 86400000000""")
def inactive_consumers(spark, d):
    """Silent for over twice a day's timeout at the time of the last event."""
    events = tables.table(spark, d, "events")
    beats = events.where("event_type = 'view'").groupBy(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("consumer_id")).agg(F.max("ts").alias("last_heartbeat"))
    now = events.agg(F.max("ts")).first()[0]
    return groups.inactive(beats, F.lit(now).cast("timestamp"), 86_400_000).select("consumer_id", "idle_ms")


@query(f"""WITH {MEMBERS}, h AS (SELECT group_id, count(*) AS n, string_agg(consumer_id, ',' ORDER BY consumer_id) AS ids FROM mem GROUP BY 1)
SELECT g.group_id, CASE WHEN n > 0 THEN 'Stable' ELSE 'Empty' END AS state, coalesce(n, 0) AS member_count, 8::BIGINT AS partition_count, coalesce(ids, '') AS members FROM grp g LEFT JOIN h USING (group_id)""")
def group_info(spark, d):
    events = _member_events(spark, d)
    return groups.info(groups.members(events), _group_partitions(events), events.select("group_id").distinct())


@query("""SELECT p::INT AS "partition", (p % 3)::INT AS consumer FROM range(8) r(p)""")
def static_assignment(spark, d):
    return spark.range(8).select(F.col("id").cast("int").alias("partition"), F.pmod("id", F.lit(3)).cast("int").alias("consumer"))


@query(f"""WITH {EV}, n AS (SELECT max(ts) AS now FROM events) SELECT topic, "partition", arg_min('n' || event_id % 5, event_id) AS node FROM ev, n WHERE ts + INTERVAL 2 DAY > now GROUP BY 1, 2""")
def leader_of_partition(spark, d):
    """Each event is a two-day lease of a node; its id is the revision."""
    rows = routed(spark, d)
    now = rows.agg(F.max("timestamp")).first()[0]
    leases = rows.select("topic", "partition", F.concat(F.lit("n"), (F.col("seq") % 5).cast("string")).alias("node"), F.col("seq").alias("revision"), (F.col("timestamp") + F.expr("interval 2 days")).alias("expires"))
    return groups.leaders(leases, F.lit(now))


# -- keys with leases: an event puts its node under its partition's key, an error deletes it


KV = EV + """, w AS (SELECT '/leader/' || topic || '/' || "partition" || '/' || substr(key, 6)::BIGINT % 10 AS key, CASE WHEN topic <> 'ev-error' OR event_id % 3 = 0 THEN 'n' || event_id % 5 END AS value, event_id AS revision, ts + INTERVAL 2 DAY AS expires FROM ev),
n AS (SELECT max(ts) AS now FROM events),
st AS (SELECT key, arg_max({'v': value, 'e': expires}, revision) AS x, max(revision) AS revision FROM w GROUP BY 1),
live AS (SELECT key, x.v AS value, revision FROM st, n WHERE x.v IS NOT NULL AND x.e > now)"""


def _writes(rows: DataFrame) -> DataFrame:
    key = F.concat_ws("/", F.lit("/leader"), "topic", F.col("partition").cast("string"), (F.expr("cast(substring(key, 6) as bigint)") % 10).cast("string"))
    value = F.when((F.col("topic") != "ev-error") | (F.col("seq") % 3 == 0), F.concat(F.lit("n"), (F.col("seq") % 5).cast("string")))
    return rows.select(key.alias("key"), value.alias("value"), F.col("seq").alias("revision"), (F.col("timestamp") + F.expr("interval 2 days")).alias("expires"))


@query(f"""WITH {KV} SELECT * FROM live""")
def kv_state(spark, d):
    rows = routed(spark, d)
    return kv.state(_writes(rows), F.lit(rows.agg(F.max("timestamp")).first()[0]))


@query(f"""WITH {KV} SELECT * FROM live WHERE starts_with(key, '/leader/ev-c')""")
def kv_list(spark, d):
    return kv.listed(kv_state(spark, d), "/leader/ev-c")


@query(f"""WITH {KV}, b AS (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY revision) AS before FROM w) SELECT key, value, revision FROM b WHERE value IS NOT NULL AND before IS NULL""")
def kv_creations(spark, d):
    """Puts that found their key free: the elections that a node won."""
    return kv.creations(_writes(routed(spark, d)))


@query(f"""WITH {KV}, b AS (SELECT w.*, expires - INTERVAL 2 DAY AS put_at, lag(value) OVER k AS before, lag(expires) OVER k AS until FROM w WINDOW k AS (PARTITION BY key ORDER BY revision))
SELECT key, value, revision FROM b WHERE value IS NOT NULL AND (before IS NULL OR until <= put_at)""")
def kv_elections(spark, d):
    """Puts that found their key free or its lease run out at the time."""
    return kv.elections(_writes(routed(spark, d)).withColumn("at", F.col("expires") - F.expr("interval 2 days")))


@query(f"""WITH {KV} SELECT revision, key, CASE WHEN value IS NULL THEN 'delete' ELSE 'put' END AS kind, value FROM w WHERE starts_with(key, '/leader/ev-e') AND revision > 100""")
def kv_watch(spark, d):
    return kv.watch(_writes(routed(spark, d)), "/leader/ev-e", 100)


@query("""WITH e AS (SELECT user_id AS lease, event_id AS revision, ts AS seen, CASE WHEN event_type = 'error' AND user_id % 10 = 0 THEN 'revoke' WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'grant' ELSE 'keepalive' END AS kind FROM events),
o AS (SELECT *, seen + INTERVAL 12 HOUR AS until FROM e WHERE kind <> 'revoke'),
l AS (SELECT *, coalesce(kind = 'keepalive' AND lag(until) OVER k <= seen, false)::INT AS late FROM o WINDOW k AS (PARTITION BY lease ORDER BY revision)),
a AS (SELECT *, sum(late) OVER (PARTITION BY lease ORDER BY revision ROWS UNBOUNDED PRECEDING) AS dead FROM l)
SELECT lease, max(until) AS expires FROM a WHERE dead = 0 AND lease NOT IN (SELECT lease FROM e WHERE kind = 'revoke') GROUP BY 1""")
def kv_leases(spark, d):
    """A user's first event is a lease of twelve hours, later ones keep it alive; an error of each tenth user revokes it."""
    events = tables.table(spark, d, "events")
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) == 1
    kind = F.when((F.col("event_type") == "error") & (F.col("user_id") % 10 == 0), "revoke").when(first, "grant").otherwise("keepalive")
    rows = events.select(F.col("user_id").alias("lease"), F.col("event_id").alias("revision"), F.col("ts").alias("at"), kind.alias("kind"), F.lit(43_200).alias("ttl_s"))
    return kv.leases(rows)


# -- batching


SIZES = EV + """, m AS (SELECT topic, octet_length(key::BLOB) + octet_length(value::BLOB) AS size, row_number() OVER (PARTITION BY topic ORDER BY ts, event_id) AS rn FROM ev)"""
COUNTED = SIZES + """, b AS (SELECT topic, (rn - 1) // 100 AS batch, count(*) AS messages, sum(size)::BIGINT AS bytes FROM m GROUP BY 1, 2)"""


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return tables.messages(spark, d).withColumn("size", hashing.message_bytes(F.col("key"), F.col("value")))


@query(f"""WITH {COUNTED} SELECT * FROM b""")
def batch_by_count(spark, d):
    return batching.by_count(_sized(spark, d), 100)


@query(f"""WITH RECURSIVE {SIZES}, f AS (SELECT topic, rn, 0::BIGINT AS batch, 1::BIGINT AS n, size::BIGINT AS bytes FROM m WHERE rn = 1
UNION ALL SELECT m.topic, m.rn, CASE WHEN n >= 100 OR bytes + size > 1500 THEN batch + 1 ELSE batch END, CASE WHEN n >= 100 OR bytes + size > 1500 THEN 1 ELSE n + 1 END, CASE WHEN n >= 100 OR bytes + size > 1500 THEN size ELSE bytes + size END FROM f JOIN m ON m.topic = f.topic AND m.rn = f.rn + 1)
SELECT topic, batch, max(n) AS messages, max(bytes) AS bytes FROM f GROUP BY 1, 2""")
def batch_by_bytes(spark, d):
    return batching.by_bytes(_sized(spark, d), 100, 1500)


@query(f"""WITH {COUNTED} SELECT count(*) AS batches, sum(messages)::BIGINT AS messages, sum(bytes)::BIGINT AS bytes, round(3 * 100.0::DOUBLE / sum(messages), 6) AS error_percent FROM b""")
def batch_metrics(spark, d):
    return batching.metrics(batch_by_count(spark, d), 3)


@query("""SELECT id + 1 AS attempt, CASE WHEN id = 0 THEN 0 ELSE (10 * 2 ** (id - 1))::BIGINT END AS wait_ms, (10 * (2 ** id - 1))::BIGINT AS waited_ms FROM range(4) t(id)""")
def retry_schedule(spark, d):
    return batching.retry_schedule(spark)


# -- figures of the load generators


@query("""SELECT 'ev-' || event_type AS topic, count(*) AS messages, round(count(*)::DOUBLE / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE), 6) AS per_second FROM events GROUP BY 1""")
def throughput(spark, d):
    return stats.throughput(tables.messages(spark, d))


@query("""WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM (SELECT value FROM events ORDER BY ts, event_id LIMIT 10000))
SELECT (SELECT count(*) FROM events) AS samples, (SELECT round(avg(value), 6) FROM events) AS avg_latency, (SELECT value FROM s WHERE r = least(floor(n * 0.99)::BIGINT, n - 1)) AS p99""")
def latency_stats(spark, d):
    return stats.latency(tables.table(spark, d, "events"), "value", ["ts", "event_id"])


PARTS = EV + """, c AS (SELECT a.p::INT AS "partition", count(ev.topic) AS n FROM range(8) a(p) LEFT JOIN ev ON ev."partition" = a.p GROUP BY 1)"""


def _counts(spark: SparkSession, d: str, n: int = 8) -> DataFrame:
    """The benchmark counts eight partitions; the topic has four."""
    held = routed(spark, d).groupBy("partition").agg(F.count("*").alias("n"))
    return spark.range(n).select(F.col("id").cast("int").alias("partition")).join(held, "partition", "left").select("partition", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"""WITH {PARTS} SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS percent FROM c""")
def partition_histogram(spark, d):
    return stats.histogram(_counts(spark, d))


@query(f"""WITH {PARTS} SELECT round(var_pop(n) / avg(n) * 100, 6) AS dispersion_percent FROM c""")
def partition_dispersion(spark, d):
    return stats.dispersion(_counts(spark, d))


@query("""SELECT least(100.0::DOUBLE, count(*) / 8.0::DOUBLE / 10.0::DOUBLE * 100) AS efficiency_percent, 100.0::DOUBLE AS unbatched_percent FROM events""")
def batch_efficiency(spark, d):
    n = F.count("*")
    return tables.table(spark, d, "events").agg(stats.batch_efficiency(n, 8, 10).alias("efficiency_percent"), stats.batch_efficiency(n, 8, 1).alias("unbatched_percent"))


@query("""WITH r AS (SELECT p_partkey, p_retailprice * 40 AS rate, p_size::DOUBLE AS p99_ms, p_size / 2.0::DOUBLE AS dispersion FROM part)
SELECT p_partkey, CASE WHEN rate >= 50000 THEN 'EXCELLENT' WHEN rate >= 30000 THEN 'GOOD' ELSE 'NEEDS IMPROVEMENT' END AS throughput, CASE WHEN p99_ms <= 10 THEN 'EXCELLENT' WHEN p99_ms <= 50 THEN 'GOOD' ELSE 'NEEDS IMPROVEMENT' END AS latency, CASE WHEN dispersion <= 5 THEN 'EXCELLENT' WHEN dispersion <= 15 THEN 'GOOD' ELSE 'NEEDS IMPROVEMENT' END AS load FROM r""")
def verdicts(spark, d):
    """Each part stands for a run: price times 40 messages a second, size in ms, half of it in percent."""
    at_most = lambda x, best, good: F.when(x <= best, "EXCELLENT").when(x <= good, "GOOD").otherwise("NEEDS IMPROVEMENT")
    size = F.col("p_size").cast("double")
    return tables.table(spark, d, "part").select("p_partkey", names.throughput_verdict(F.col("p_retailprice") * 40).alias("throughput"), at_most(size, 10, 50).alias("latency"), at_most(size / 2, 5, 15).alias("load"))


@query("""SELECT k.id::BIGINT AS idx, ['user', 'order', 'session', 'event'][(k.id % 4 + 1)::INT] || '-' || (k.id // 4 % 8) || '-' || (k.id // 32) || '-' || (k.id * 104729 % 10000) AS key FROM range(1000) k(id)""")
def load_keys(spark, d):
    """Keys like the load generator's, kind-producer-batch-number, from a rule in place of the clock."""
    kinds = F.element_at(F.array(*map(F.lit, ("user", "order", "session", "event"))), (F.col("id") % 4 + 1).cast("int"))
    return spark.range(1000).select(F.col("id").alias("idx"), F.concat_ws("-", kinds, F.expr("cast(id div 4 % 8 as string)"), F.expr("cast(id div 32 as string)"), (F.col("id") * 104729 % 10000).cast("string")).alias("key"))
