"""Operator 3: mixture-controlled packing by deficit round-robin over source queues.

Documents are cut into packets of at most one sequence. Each source is a queue of
packets with a share of the tokens. In every round a queue's deficit grows by its
share of ``length / ROUNDS`` tokens, and packets are served while the deficit covers
them; what is left is carried into the next round. As all queues hold rows from the start,
the packet that ends at token e of its queue is served in round ceil(e / quantum),
so the rounds need no loop: a queue's running sums give them, and deficits carry
across rounds, windows and partitions alike. Packets in the order of rounds form one stream
that is cut every ``length`` tokens, and ``window_sequences`` sequences are a window: every
window but the last is full, holds the targets' proportions to about a packet a source, and mixes the
sources within its sequences. A queue that drains takes part in no further round, so the
others fill the windows in the proportions of their own shares. Only the last
sequence has padding.

Targets are shares by source, or a power: each source's share goes with its tokens to
that power (1: the corpus' own mixture, kept to the end; below, small sources
come earlier; ``TEMPER`` in the query and the pipeline). Sources without a target share one
queue, which gets what the targets leave, or comes last. At most ``MOST_QUEUES`` sources, the
largest, have queues of their own; the others' packets share one.

Running sums are taken in two steps (within a block, over the blocks' totals), so
that no task sorts a whole source or the whole stream. One task takes the totals of all
blocks, a row for each split of the input, or some two million tokens of the stream.

Null texts count as empty (one end id); a null source is a queue of its own;
repeated rows are packed each; an empty table gives no piece.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

LENGTH = 2048
ROUNDS, MOST_QUEUES, TEMPER = 8, 256, 0.7
#: Sequences, about, that one task orders.
BAND = 1024
NULL, REST = "\0null", "\0rest"


def _encode(batches, tokenizer: str, end_id: int, call: str):
    encoder = tokens.encoder(tokenizer, call)
    end = struct.pack("<I", end_id)
    next_id = TaskContext.get().partitionId() << 33
    for b in batches:
        ids = [np.frombuffer(encoder.encode(x) + end, "<u4").astype(encoder.width).tobytes() for x in b.column(2).to_pylist()]
        width = int(encoder.width[-1])
        rid = pa.array(range(next_id, next_id + len(ids)), pa.int64())
        next_id += len(ids)
        yield pa.RecordBatch.from_arrays([rid, b.column(0), b.column(1), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["rid", "doc_id", "source", "n", "ids"])


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """rid, doc_id, source, n, ids of every document, written down; a rid tells the
    split (rid >> 33) and the row's place in it."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), common.text_of().alias("text"))
    call = uuid.uuid4().hex
    return common.materialise(rows.mapInArrow(lambda x: _encode(x, tokenizer, end_id, call), "rid long, doc_id long, source string, n long, ids binary"), "encoded")


def _before(df: DataFrame, block: list, order: list, value: str, within: list, out: str) -> DataFrame:
    """``out``: the sum of ``value`` before each row, by ``block`` then ``order``, and
    ``whole``: the sum of all; separately for each value of ``within``. Blocks' totals
    are summed apart."""
    upto = (Window.unboundedPreceding, -1)
    totals = df.groupBy(*within, *block).agg(F.sum(value).alias("_total"))
    bases = totals.select(*within, *block, F.coalesce(F.sum("_total").over(Window.partitionBy(*within).orderBy(*block).rowsBetween(*upto)), F.lit(0)).alias("_base"), F.sum("_total").over(Window.partitionBy(*within)).alias("whole"))
    inner = df.withColumn("_inner", F.coalesce(F.sum(value).over(Window.partitionBy(*within, *block).orderBy(*order).rowsBetween(*upto)), F.lit(0)))
    return inner.join(bases, [*within, *block]).withColumn(out, F.col("_base") + F.col("_inner")).drop("_base", "_inner")


def queues(encoded: DataFrame, targets: Mapping[str, float] | float | None) -> list[tuple[str, int, float]]:
    """(queue, tokens, share) of at most MOST_QUEUES sources and the rest."""
    own = F.coalesce("source", F.lit(NULL))
    if isinstance(targets, Mapping):
        own = F.when(own.isin([x for x, share in targets.items() if share > 0]), own).otherwise(REST)
    totals = encoded.groupBy(own.alias("queue")).agg(F.sum("n").alias("n"))
    first = [(r.queue, r.n) for r in totals.orderBy(F.desc("n"), "queue").limit(MOST_QUEUES + 2).collect()]
    held = [x for x in first if x[0] != REST][:MOST_QUEUES]
    every = sum(n for _, n in first) if len(first) < MOST_QUEUES + 2 else totals.agg(F.sum("n")).first()[0]
    rest = every - sum(n for _, n in held)
    if isinstance(targets, Mapping):
        left = max(1 - sum(x for x in targets.values() if x > 0), 1e-9)
        shares = [float(targets[q]) for q, _ in held]
    else:
        power = 1.0 if targets is None else float(targets)
        left, shares = float(rest) ** power, [float(n) ** power for _, n in held]
    found = [(q, n, share) for (q, n), share in zip([*held, (REST, rest)], [*shares, left], strict=True) if n]
    whole = sum(share for *_, share in found)
    return [(q, n, share / whole) for q, n, share in found]


def _served(level: Column, held: list[tuple[str, int, float]]) -> Column:
    """Tokens that all queues have been served when those that haven't drained had ``level`` times their share."""
    ends = sorted((n / share, n, share) for _, n, share in held)
    done, open_, out = 0, sum(share for *_, share in ends), None
    for end, n, share in ends:
        part = F.lit(float(done)) + level * F.lit(open_)
        out = F.when(level <= end, part) if out is None else out.when(level <= end, part)
        done, open_ = done + n, max(open_ - share, 0.0)
    return F.lit(0.0) if out is None else out.otherwise(F.lit(float(done)))


def plan(encoded: DataFrame, length: int = LENGTH, window_sequences: int = 64, targets: Mapping[str, float] | float | None = None) -> DataFrame:
    """rid, start, length, sequence_id, offset, window of every piece."""
    held = queues(encoded, targets)
    own = F.coalesce("source", F.lit(NULL))
    queue = F.when(own.isin([q for q, *_ in held]), own).otherwise(REST)
    known = encoded.sparkSession.createDataFrame([(q, share) for q, _, share in held], "queue string, share double")
    lens = encoded.select("rid", queue.alias("queue"), "n", F.shiftright("rid", 33).alias("split"))
    placed = _before(lens, ["split"], ["rid"], "n", ["queue"], "at").join(F.broadcast(known), "queue")
    quantum = F.col("share") * F.lit(length / ROUNDS)
    packets = (
        placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {length}"))))
        .withColumn("start", F.col("k") * length)
        .withColumn("size", F.least(F.lit(length).cast("long"), F.col("n") - F.col("start")))
        .withColumn("until", F.col("at") + F.col("start") + F.col("size"))
        .withColumn("round", F.ceil(F.col("until") / quantum))
        .select("rid", "queue", "start", "size", "until", "round", F.floor(_served(F.col("round") * F.lit(length / ROUNDS), held) / (length * BAND)).alias("band"))
    )
    stream = _before(packets, ["band"], ["round", "queue", "until"], "size", [], "place")
    first = F.least(F.col("size"), length - F.col("place") % length)
    cut = F.array(
        F.struct(F.col("start"), first.alias("length"), F.col("place")),
        F.struct((F.col("start") + first).alias("start"), (F.col("size") - first).alias("length"), (F.col("place") + first).alias("place")),
    )
    return (
        stream.select("rid", F.explode(F.filter(cut, lambda x: x["length"] > 0)).alias("p"))
        .select("rid", F.col("p.start").alias("start"), F.col("p.length").alias("length"), F.expr(f"p.place div {length}").alias("sequence_id"), (F.col("p.place") % length).alias("offset"))
        .withColumn("window", F.expr(f"sequence_id div {window_sequences}"))
    )


PIECE = "doc_id long, source string, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long"


def _cut(batches, width: str, with_ids: bool):
    names = [x.split()[0] for x in PIECE.split(", ")]
    for b in batches:
        out: dict[str, list] = {x: [] for x in names}
        for doc_id, source, n, ids, pieces in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            ids = np.frombuffer(ids, width)
            for p in sorted(pieces, key=lambda p: p["start"]):
                own = ids[p["start"] : p["start"] + p["length"]].astype("<u4").tobytes()
                for x, v in zip(names, (doc_id, source, p["start"], p["length"], own if with_ids else None, zlib.crc32(own), n, p["sequence_id"], p["offset"], p["window"]), strict=True):
                    out[x].append(v)
        yield pa.RecordBatch.from_pydict({x: pa.array(v, {"source": pa.string(), "ids": pa.binary()}.get(x, pa.int64())) for x, v in out.items()})


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, window_sequences: int = 64, targets: Mapping[str, float] | float | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their ids (none if not with_ids) and places."""
    encoded = encode(docs, tokenizer, end_id)
    width = tokens.encoder(tokenizer).width
    pieces = plan(encoded, length, window_sequences, targets)
    held = pieces.groupBy("rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset", "window")).alias("pieces"))
    return encoded.join(held, "rid").select("doc_id", "source", "n", "ids", "pieces").mapInArrow(lambda x: _cut(x, width, with_ids), PIECE)


def padded_length(tokens_held: int, length: int = LENGTH) -> int:
    """Ids that a sequence takes: as it is at a power of two, else padded to length."""
    return tokens_held if tokens_held and tokens_held & (tokens_held - 1) == 0 else length


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every piece of every document, end id 1."""
    pieces = pack(common.table(spark, sf_dir, "documents"), tokens.tokenizer_path(), 1, targets=TEMPER, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window")
