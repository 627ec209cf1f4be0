"""How a batching producer cuts each topic's messages into batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import ship
from . import prefix

MESSAGES, BYTES, RETRIES, BACKOFF_MS = 1000, 1 << 20, 3, 10


def by_count(messages: DataFrame, most: int = MESSAGES) -> DataFrame:
    """topic, batch, messages, bytes when the count alone ends a batch; messages: topic, timestamp, seq, size."""
    most = most if most > 0 else MESSAGES
    numbered = prefix.numbered(messages, ["topic"], prefix.hour("timestamp"), ["timestamp", "seq"], "number")
    return numbered.groupBy("topic", F.expr(f"number div {most}").alias("batch")).agg(F.count("*").alias("messages"), F.sum("size").alias("bytes"))


def _fold(batches, most: int, most_bytes: int):
    """A batch ends before the message that would make it too many or too large. Rows
    come sorted, so only the open batch is held; running sums are searched for a batch's end."""
    topic, number, count, size = None, 0, 0, 0
    out: list[tuple] = []
    for b in batches:
        runs = b.column(0).dictionary_encode()
        codes = runs.indices.fill_null(-1).to_numpy()
        upto = np.concatenate(([0], np.cumsum(b.column(1).to_numpy(zero_copy_only=False))))
        edges = [*np.flatnonzero(np.diff(codes, prepend=-2)).tolist(), len(codes)]
        for at, end in zip(edges, edges[1:], strict=False):
            t = runs.dictionary[int(codes[at])].as_py() if codes[at] >= 0 else None
            if t != topic:
                if count:
                    out.append((topic, number, count, size))
                topic, number, count, size = t, 0, 0, 0
            while at < end:
                fits = int(np.searchsorted(upto, upto[at] + most_bytes - size, side="right")) - 1
                fits = min(fits, at + most - count, end)
                if fits <= at:
                    if count:
                        out.append((topic, number, count, size))
                        number, count, size = number + 1, 0, 0
                        continue
                    fits = at + 1
                count, size, at = count + fits - at, size + int(upto[fits] - upto[at]), fits
        if len(out) > 10_000:
            yield _rows(out)
            out = []
    if count:
        out.append((topic, number, count, size))
    yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["topic", "batch", "messages", "bytes"])


def by_bytes(messages: DataFrame, most: int = MESSAGES, most_bytes: int = BYTES) -> DataFrame:
    """topic, batch, messages, bytes when count or bytes end a batch. Where a batch
    starts depends on all before it, so a topic (or producer of one) is one task's
    sorted stream; a message over the limit is a batch of its own. Sizes that are null count as 0."""
    most, most_bytes = most if most > 0 else MESSAGES, most_bytes if most_bytes > 0 else BYTES
    ship(messages.sparkSession)
    ordered = messages.repartition("topic").sortWithinPartitions("topic", "timestamp", "seq").select("topic", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    return ordered.mapInArrow(lambda x: _fold(x, most, most_bytes), "topic string, batch long, messages long, bytes long")


def metrics(batches: DataFrame, errors: int = 0) -> DataFrame:
    return batches.agg(F.count("*").alias("batches"), F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes"), F.round(F.try_divide(F.lit(float(errors)) * 100, F.sum("messages")), 6).alias("error_percent"))


def retry_schedule(spark: SparkSession, retries: int = RETRIES, backoff_ms: int = BACKOFF_MS) -> DataFrame:
    """attempt, wait_ms before it, waited_ms in all: none before the first, then doubling."""
    attempt = F.col("id") + 1
    wait = F.when(F.col("id") == 0, F.lit(0)).otherwise(F.lit(backoff_ms) * F.pow(F.lit(2.0), F.col("id") - 1))
    return spark.range(retries + 1).select(attempt.alias("attempt"), wait.cast("long").alias("wait_ms"), (F.lit(backoff_ms) * (F.pow(F.lit(2.0), F.col("id")) - 1)).cast("long").alias("waited_ms"))
