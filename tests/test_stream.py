"""Streams: two runs go on where the first one ended; late rows; windows."""

import datetime as dt

from pyspark.sql import functions as F

from loomlog.operators import log
from loomlog.streaming import log as streams
from loomlog.streaming import windows

AT = dt.datetime(2024, 1, 1)


def _batch(spark, path, first, n):
    rows = [("t", k % 2, AT + dt.timedelta(minutes=k), k) for k in range(first, first + n)]
    spark.createDataFrame(rows, "topic string, partition int, timestamp timestamp, seq long").coalesce(1).write.mode("append").parquet(path)


def test_offsets_go_on_from_the_checkpoint(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    _batch(spark, source, 0, 10)
    streams.finish(streams.assign_offsets(streams.source(spark, source)), out)
    _batch(spark, source, 10, 7)
    got = streams.finish(streams.assign_offsets(streams.source(spark, source)), out)
    want = log.assign_offsets(spark.read.parquet(source)).select("topic", "partition", "seq", "offset")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_commits_of_each_batch(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    _batch(spark, source, 0, 10)
    stream = lambda: streams.source(spark, source).withColumnRenamed("seq", "offset")
    streams.commit_stream(stream(), out, "g")
    _batch(spark, source, 10, 4)
    got = {tuple(r) for r in streams.commit_stream(stream(), out, "g").select("partition", "offset", "commit_seq").collect()}
    assert got == {(0, 9, 0), (1, 10, 0), (0, 13, 1), (1, 14, 1)}


def test_silent_consumers_leave_and_may_come_back(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    beat = lambda rows: spark.createDataFrame([(c, AT + dt.timedelta(seconds=s)) for c, s in rows], "consumer_id string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    beat([("a", 0), ("b", 0), ("b", 100)])
    run = lambda: sorted(r.consumer_id for r in streams.finish(streams.evict(streams.source(spark, source), 30_000), out).collect())
    assert run() == ["a"]
    beat([("a", 120), ("c", 200)])
    assert run() == ["a", "a", "b"]


def test_late_rows_are_dropped(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put = lambda *hours: spark.createDataFrame([(AT + dt.timedelta(hours=h), 1.0) for h in hours], "ts timestamp, value double").coalesce(1).write.mode("append").parquet(source)
    run = lambda: {(r.start.hour, r.events) for r in streams.finish(windows.tumbling(streams.source(spark, source), "1 hour", [], "2 hours"), out).collect()}
    put(0, 1, 9)
    assert run() == {(0, 1), (1, 1)}
    put(1, 8, 20)
    assert run() == {(0, 1), (1, 1), (8, 1), (9, 1)}


def test_sessions(spark):
    rows = spark.createDataFrame([("u", AT + dt.timedelta(minutes=m)) for m in (0, 5, 30, 34)], "user string, ts timestamp")
    got = sorted((r.start.minute, r.events) for r in windows.sessions(rows, "10 minutes", ["user"]).collect())
    assert got == [(0, 2), (30, 2)]
    assert windows.sessions(rows.where(F.lit(False)), "10 minutes", ["user"]).count() == 0


def test_siblings_of_a_path_are_not_read(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    _batch(spark, source, 0, 6)
    _batch(spark, f"{source}_old", 6, 5)
    got = streams.finish(streams.read_from(streams.source(spark, source).withColumnRenamed("seq", "offset"), "t", 0, 2), out)
    assert sorted(r.offset for r in got.collect()) == [2, 4]
