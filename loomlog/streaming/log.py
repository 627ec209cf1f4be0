"""Offsets, reads and commits on streams.

State is one number for each topic and partition; a checkpoint keeps it with the
output, so a stopped stream goes on without gaps or repeats. Batches given to
foreachBatch are written under their number and overwrite their own repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OFFSETS = "topic string, partition int, seq long, offset long"


def use_rocksdb(spark: SparkSession) -> None:
    """What keyed state in Python needs."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def source(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of a folder's (or file's) Parquet rows, so many files at a time.

    The path is given as a pattern that only it matches, since a stream's plain path must be a folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def read_from(messages: DataFrame, topic: str, partition: int, offset: int) -> DataFrame:
    """A stream of a log's messages (topic, partition, offset, ...) from an offset on, then all that come."""
    return messages.where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") >= max(offset, 0)))


class NextOffset(StatefulProcessor):
    """The next offset of a topic's partition; a micro-batch's rows are taken in order.

    Times and numbers of one key's rows in one micro-batch are held, which the source's files a trigger bound."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "offset long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat([x[["timestamp", "seq"]] for x in rows]).sort_values(["timestamp", "seq"], kind="stable")
        first = self.next.get()[0] if self.next.exists() else 0
        self.next.update((first + len(held),))
        yield pd.DataFrame({"topic": key[0], "partition": key[1], "seq": held["seq"].to_numpy(), "offset": range(first, first + len(held))})

    def close(self) -> None:
        pass


def assign_offsets(messages: DataFrame) -> DataFrame:
    """topic, partition, seq, offset of a stream of routed messages (topic, partition, timestamp, seq)."""
    use_rocksdb(messages.sparkSession)
    grouped = messages.select("topic", "partition", "timestamp", "seq").groupBy("topic", "partition")
    return grouped.transformWithStateInPandas(NextOffset(), OFFSETS, "Append", "None")


class Silence(StatefulProcessor):
    """Sends a consumer's last heartbeat once the watermark is over twice its timeout past it."""

    def __init__(self, timeout_ms: int):
        self.limit = 2 * timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(x["ts"].max().value // 1_000_000 for x in rows)
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or newest > before:
            if before is not None:
                self.handle.deleteTimer(before + self.limit + 1)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.limit + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"consumer_id": [key[0]], "last_heartbeat_ms": [self.last.get()[0]]})
        self.last.clear()

    def close(self) -> None:
        pass


def evict(beats: DataFrame, timeout_ms: int, lateness: str = "0 seconds") -> DataFrame:
    """consumer_id, last_heartbeat_ms of consumers that fall silent; beats: consumer_id, ts."""
    use_rocksdb(beats.sparkSession)
    grouped = beats.withWatermark("ts", lateness).groupBy("consumer_id")
    return grouped.transformWithStateInPandas(Silence(timeout_ms), "consumer_id string, last_heartbeat_ms long", "Append", "EventTime")


def finish(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream to the present end of its input; what it wrote, all or the last state.

    The checkpoint is in the same folder, so a later call on the same path goes on."""
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/rows").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def commit_stream(consumed: DataFrame, path: str, group: str) -> DataFrame:
    """Commit the offset after the last message of each micro-batch; the commits."""

    def put(batch: DataFrame, number: int) -> None:
        done = batch.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("offset"))
        done.select(F.lit(group).alias("consumer_group"), "topic", "partition", "offset", F.lit(number).cast("long").alias("commit_seq")).write.mode("overwrite").parquet(f"{path}/commits/batch={number}")

    query = consumed.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return consumed.sparkSession.read.parquet(f"{path}/commits").drop("batch")
