"""A Bloom filter with saturating counts, built where the rows are.

Each cell counts 0, 1 or "2 and more", kept as two bitmaps (once, twice). Two
filters merge by twice = t1 | t2 | (o1 & o2), once = o1 | o2, in any order. A
hash that occurs twice has all its cells at 2, so testing ``twice`` has no false
negative. The bitmaps' size is capped; a fuller filter lets more rows through to
the exact step and never changes the outcome.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK_BITS = 1 << 16
HASHES = 3


def cells(n: int, per_key: int = 12, most_bits: int = 1 << 28) -> int:
    """Cells for n keys: a power of two, at most most_bits (32 MiB a bitmap)."""
    want = max(CHUNK_BITS, n * per_key)
    return min(most_bits, 1 << (want - 1).bit_length())


def positions(keys: np.ndarray, size: int) -> np.ndarray:
    """Distinct odd steps from the key's two halves: HASHES cells a key, as a (HASHES, n) array."""
    keys = keys.astype(np.uint64, copy=False)
    mixed = keys ^ (keys >> np.uint64(31))
    mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
    step = (mixed >> np.uint64(17)) | np.uint64(1)
    base = mixed ^ (mixed >> np.uint64(29))
    return np.stack([(base + np.uint64(k) * step) & np.uint64(size - 1) for k in range(HASHES)])


#: Keys that a task takes together: their cells are sorted and sent once.
TOGETHER = 500_000


def _sparse(batches, size: int, least: int):
    """Chunks of the filter that this task's keys meet, compressed.

    least 1: a plain set filter (every met cell counts as twice)."""
    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
        held.append(keys)
        n += len(keys)
        if n >= TOGETHER:
            yield _chunks(np.concatenate(held), size, least)
            held, n = [], 0
    if n:
        yield _chunks(np.concatenate(held), size, least)


def _chunks(keys: np.ndarray, size: int, least: int) -> pa.RecordBatch:
    cell, count = np.unique(positions(keys, size).ravel(), return_counts=True)
    chunk = (cell // CHUNK_BITS).astype(np.int64)
    edges = np.flatnonzero(np.diff(chunk)) + 1
    out: dict[str, list] = {"chunk": [], "once": [], "twice": []}
    for at, twice in zip(np.split((cell % CHUNK_BITS).astype(np.int64), edges), np.split(count >= least, edges), strict=True):
        for name, met in (("once", at), ("twice", at[twice])):
            bits = np.zeros(CHUNK_BITS, bool)
            bits[met] = True
            out[name].append(zlib.compress(np.packbits(bits).tobytes(), 1))
    out["chunk"] = chunk[np.concatenate(([0], edges))].tolist()
    return pa.RecordBatch.from_pydict({"chunk": pa.array(out["chunk"], pa.int64()), "once": out["once"], "twice": out["twice"]})


#: Parts that a chunk's rows are merged in before they meet.
PARTS = 64
MERGED = "chunk long, once binary, twice binary"


def _merge(batches):
    """One row for each run of a chunk's rows; they come sorted, and one pair of bitmaps is held at a time."""
    chunk, once, twice = None, np.empty(0, np.uint8), np.empty(0, np.uint8)

    def row():
        packed = [pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (once, twice)]
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *packed], names=["chunk", "once", "twice"])

    for b in batches:
        for c, o, t in zip(*(b.column(x).to_pylist() for x in ("chunk", "once", "twice")), strict=True):
            o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
            if c == chunk:
                once, twice = once | o, twice | t | (once & o)
            else:
                if chunk is not None:
                    yield row()
                chunk, once, twice = c, o, t
    if chunk is not None:
        yield row()


def build(keys: DataFrame, n: int, least: int = 2, per_key: int = 12) -> bytes:
    """The bitmap of cells at ``twice`` over keys' one long column; at most 32 MiB.

    A task sends the chunks it met. They are merged as they stream by, in ``PARTS``
    parts first, so a merge holds one chunk whatever the number of tasks. least=2:
    keys that may occur twice; least=1: keys that may occur at all.
    """
    size = cells(n, per_key)
    common.prepare(keys.sparkSession)
    sent = keys.mapInArrow(lambda x: _sparse(x, size, least), MERGED).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    parts = sent.repartition("chunk", "part").sortWithinPartitions("chunk", "part").select("chunk", "once", "twice").mapInArrow(_merge, MERGED)
    merged = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merge, MERGED).select("chunk", "twice")
    out = np.zeros(size // 8, np.uint8)
    for row in merged.toLocalIterator():
        bits = np.frombuffer(zlib.decompress(row.twice), np.uint8)
        out[row.chunk * (CHUNK_BITS // 8) :][: len(bits)] = bits
    return out.tobytes()


def test(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in. bitmap: of np.uint8."""
    found = np.ones(len(keys), bool)
    for at in positions(keys, len(bitmap) * 8):
        at = at.astype(np.int64)
        found &= (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 != 0
    return found
