"""The log kept as Parquet: topics, live partitions, messages, commits, each a folder.

Messages are partitioned by topic and partition and sorted by offset in their files, so
a read prunes folders and row groups. A batch of messages is one write of the file
commit protocol: all of it or nothing. There is one writer for a topic at a time.
Next offsets are kept in a table of their own, and what a writer that died has left
beyond them is found by a read that prunes all older row groups. Nothing is written
over: topics, commits and deletions of groups are rows that are appended.
Names are read back as strings, whatever they look like.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..operators import log, offsets


class StoreError(ValueError):
    """What a request over the wire is answered with."""


class LogStore:
    """persistent=False keeps no consumer offsets, as the in-memory mode of a broker."""

    def __init__(self, spark: SparkSession, path: str, persistent: bool = True):
        self.spark, self.path, self.persistent, self.closed = spark, path.rstrip("/"), persistent, False
        self._answers: list[str] = []

    def __enter__(self) -> LogStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """The answers to requests, which stand in the store's folder, go."""
        while self._answers:
            self._delete(self._answers.pop())
        self.closed = True

    def _delete(self, path: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _open(self) -> None:
        if self.closed:
            raise StoreError("storage is closed")

    def _read(self, name: str, ddl: str) -> DataFrame:
        self._open()
        fields = T._parse_datatype_string(ddl)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).parquet(f"{self.path}/{name}")

    # -- topics

    def _topic_events(self) -> DataFrame:
        return self._read("topics", schema.TOPIC_EVENT)

    def partitions(self, topic: str | None = None) -> DataFrame:
        """topic, partition of the live ones."""
        rows = self._topic_events()
        rows = rows if topic is None else rows.where(F.col("topic") == topic)
        return rows.groupBy("topic", "partition").agg(F.max_by("live", "version").alias("live")).where("live").drop("live")

    def _put(self, rows: list[tuple[str, int, bool]]) -> None:
        version = (self._topic_events().agg(F.max("version")).first()[0] or 0) + 1
        made = self.spark.createDataFrame([(*x, version) for x in rows], schema.TOPIC_EVENT)
        made.coalesce(1).write.mode("append").parquet(f"{self.path}/topics")

    def topics(self) -> list[str]:
        return sorted(r.topic for r in self._topic_events().select("topic").distinct().toLocalIterator())

    def num_partitions(self, topic: str) -> int:
        """One more than the largest id ever made: keys of a removed partition fail."""
        most = self._topic_events().where(F.col("topic") == topic).agg(F.max("partition")).first()[0]
        if most is None:
            raise StoreError(f"topic {topic} does not exist")
        return most + 1

    def create_topic(self, topic: str, n: int = schema.AUTO_PARTITIONS) -> None:
        if topic in self.topics():
            raise StoreError(f"topic {topic} already exists")
        self._put([(topic, p, True) for p in range(max(n, 1))])

    def _live(self, topic: str) -> list[int]:
        self.num_partitions(topic)
        return sorted(r.partition for r in self.partitions(topic).collect())  # a topic's partitions

    def add_partition(self, topic: str, partition: int) -> None:
        if partition in self._live(topic):
            raise StoreError(f"partition {partition} already exists")
        self._put([(topic, partition, True)])

    def remove_partition(self, topic: str, partition: int) -> None:
        """Its messages go; the number that keys are routed over stays."""
        if partition not in self._live(topic):
            raise StoreError(f"partition {partition} does not exist")
        self._put([(topic, partition, False)])
        name = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(topic)
        self._delete(f"{self.path}/messages/topic={name}/partition={partition}")
        self._put_next(topic, {partition: 0})

    def scale(self, topic: str, n: int) -> tuple[int, int]:
        """The old and the new number. No message moves; later keys are routed anew."""
        if n <= 0:
            raise StoreError("new partition count must be positive")
        old = self.num_partitions(topic)
        if n < old:
            raise StoreError("scaling down partitions not supported (data loss risk)")
        if n > old:
            self._put([(topic, p, True) for p in range(old, n)])
        return old, n

    # -- messages

    def messages(self) -> DataFrame:
        return self._read("messages", schema.MESSAGE)

    def info(self, topic: str) -> DataFrame:
        self.num_partitions(topic)
        return log.info(self.messages().where(F.col("topic") == topic), self.partitions(topic)).orderBy("partition")

    def _next(self, topic: str, live: list[int]) -> dict[int, int]:
        """The next offset of each live partition: as written down, or after what lies beyond."""
        held = self._read("next", schema.NEXT).where(F.col("topic") == topic).groupBy("partition").agg(F.max_by("next_offset", "version").alias("n"))
        known = dict.fromkeys(live, 0) | {r.partition: r.n for r in held.collect() if r.partition in live}  # a topic's partitions
        beyond = F.lit(False)
        for p, n in known.items():
            beyond = beyond | (F.col("partition") == p) & (F.col("offset") >= n)
        rows = self.messages().where(F.col("topic") == topic).where(beyond).groupBy("partition").agg(F.max("offset").alias("last"))
        return known | {r.partition: r.last + 1 for r in rows.collect()}

    def _put_next(self, topic: str, known: dict[int, int]) -> None:
        version = (self._read("next", schema.NEXT).agg(F.max("version")).first()[0] or 0) + 1
        made = self.spark.createDataFrame([(topic, p, n, version) for p, n in known.items()], schema.NEXT)
        made.coalesce(1).write.mode("append").parquet(f"{self.path}/next")

    def produce(self, topic: str, rows: DataFrame) -> DataFrame:
        """Append rows (idx, key, value, timestamp); idx, partition, offset, error in their order.

        An unknown topic is made with four partitions. Offsets are in the order of idx. The
        batch with its answers is written once, and what is stored is read from there, so
        both have one timestamp and one order; it stands until the store is closed."""
        if not topic:
            raise StoreError("topic name is required")
        if topic not in self.topics():
            self.create_topic(topic)
        named = rows.select("idx", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("value", F.lit(b"")).alias("value"), F.coalesce("timestamp", F.current_timestamp()).alias("timestamp"), F.lit(topic).alias("topic"))
        live = self._live(topic)
        answered = log.appended(log.routed(named, self.num_partitions(topic)), live, self._next(topic, live))
        name = f"{self.path}/pending/{uuid.uuid4().hex}"
        self._answers.append(name)
        answered.write.parquet(name)
        done = self.spark.read.schema(answered.schema).parquet(name)
        if not done.take(1):
            raise StoreError("at least one message is required")
        stored = done.where("error = ''").drop("idx", "error")
        # a partition's messages are dealt to tasks by ranges of their offsets
        dealt = stored.repartitionByRange("partition", "offset").sortWithinPartitions("partition", "offset")
        dealt.write.mode("append").partitionBy("topic", "partition").parquet(f"{self.path}/messages")
        ends = stored.groupBy("partition").agg((F.max("offset") + 1).alias("n")).collect()  # a topic's partitions
        if ends:
            self._put_next(topic, {r.partition: r.n for r in ends})
        return done.select("idx", "partition", "offset", "error").orderBy("idx")

    def consume(self, topic: str, partition: int, offset: int, most: int = schema.AUTO_MESSAGES) -> DataFrame:
        if partition not in self._live(topic):
            raise StoreError(f"partition {partition} does not exist")
        return log.read(self.messages(), topic, partition, offset, most)

    # -- offsets

    def commits(self) -> DataFrame:
        """Commits of groups that weren't deleted since."""
        rows = self._read("commits", schema.COMMIT)
        gone = rows.where("topic is null").groupBy("consumer_group").agg(F.max("commit_seq").alias("_gone"))
        held = rows.where("topic is not null").join(gone, "consumer_group", "left")
        return held.where("_gone is null or commit_seq > _gone").select(*rows.columns)

    def _put_commits(self, rows: DataFrame) -> None:
        seq = (self._read("commits", schema.COMMIT).agg(F.max("commit_seq")).first()[0] or 0) + 1
        rows.withColumn("commit_seq", F.lit(seq).cast("long")).write.mode("append").parquet(f"{self.path}/commits")

    def commit(self, rows: DataFrame) -> None:
        """Append rows (consumer_group, topic, partition, offset)."""
        if not self.persistent:
            raise StoreError("offset management not available (requires persistent storage)")
        self._put_commits(rows)

    def committed(self, group: str, topic: str, partition: int) -> int:
        """0 where none was committed, and in the mode that keeps none."""
        if not self.persistent:
            return 0
        row = offsets.of_group(self.commits(), group, topic).where(F.col("partition") == partition).first()
        return row.offset if row else 0

    def delete_group(self, group: str) -> None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("topic", "string"), ("partition", "int"), ("offset", "long"))]
        self._put_commits(self.spark.range(1).select(F.lit(group).alias("consumer_group"), *none))
