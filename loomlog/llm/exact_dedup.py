"""Operator 2: exact dedup with a two-pass Bloom filter.

Texts are equal when identical after lower-casing A-Z only. The first pass counts
hashes in a saturating Bloom filter (bloom.py); the second tests each row against
it. Rows that occur once for certain pass straight through; only the rest is
shuffled, compared by the full SHA-256, and decided: of equal texts the row with
the largest doc_id stays, of rows with that doc_id the last in file order.

Null texts count as empty, so they equal each other and the empty text; a null
doc_id is smaller than any other; an empty table gives an empty result; further
columns pass through; names that begin with two underscores are the operator's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom, caches, common


def _digests(column) -> list[bytes]:
    # bytes.lower() lowers A-Z alone, and no byte of a longer UTF-8 sequence is one
    return [hashlib.sha256(x.as_py().lower() if x.is_valid else b"").digest() for x in column.cast(pa.binary())]


def _fingerprint(batches):
    caches.only()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_digests(b.column(2)), pa.binary())], names=["_rid", "doc_id", "sha"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """_rid, doc_id, sha of every row, written down."""
    return _fingerprints(common.with_row_id(docs))


def _fingerprints(numbered: DataFrame) -> DataFrame:
    common.prepare(numbered.sparkSession)
    rows = numbered.select(F.col(common.RID).alias("_rid"), F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    return common.materialise(rows.mapInArrow(_fingerprint, "_rid long, doc_id long, sha binary"), "fingerprints")


def repeated_filter(prints: DataFrame) -> bytes:
    """First pass: the cells of hashes that may occur twice."""
    return bloom.build(prints.select(_key_column().alias("key")), prints.count())


def _key_column():
    return F.xxhash64("sha")


def _probe(batches, bits):
    bitmap = np.frombuffer(bits.value, np.uint8)
    for b in batches:
        keys = b.column(b.schema.get_field_index("key")).to_numpy(zero_copy_only=False).view(np.uint64)
        yield b.append_column("maybe", pa.array(bloom.test(bitmap, keys)))


def _probed(prints: DataFrame) -> DataFrame:
    """prints with ``maybe``: whether the row's hash may occur twice."""
    bits = prints.sparkSession.sparkContext.broadcast(repeated_filter(prints))
    keyed = prints.withColumn("key", _key_column())
    return keyed.mapInArrow(lambda x: _probe(x, bits), "_rid long, doc_id long, sha binary, key long, maybe boolean").drop("key")


def _groups(again: DataFrame) -> DataFrame:
    return again.groupBy("sha").agg(F.max(F.struct("doc_id", "_rid")).alias("top"), F.count("*").alias("group_size"))


def decide(prints: DataFrame) -> DataFrame:
    """_rid, doc_id, sha, keep_id, group_size, kept of every row of fingerprints()."""
    probed = _probed(prints)
    alone = probed.where("not maybe").select("_rid", "doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    again = common.materialise(probed.where("maybe").drop("maybe"), "repeated")
    decided = common.attach(again, _groups(again), "sha", "group_size", again.count())
    decided = decided.select("_rid", "doc_id", "sha", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("_rid") == F.col("top._rid")).alias("kept"))
    return alone.unionByName(decided)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns as they were.

    Digests of rows that may be repeated are shuffled; the rows themselves only lose
    those whose numbers aren't kept (``common.but_for``)."""
    numbered = common.with_row_id(docs)
    again = common.materialise(_probed(_fingerprints(numbered)).where("maybe").drop("maybe"), "repeated")
    decided = common.attach(again, _groups(again), "sha", "group_size", again.count())
    gone = common.materialise(decided.where(F.col("_rid") != F.col("top._rid")).select(F.col("_rid").alias(common.RID)), "gone")
    return common.but_for(numbered, gone)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the decision on each document."""
    return decide(fingerprints(common.table(spark, sf_dir, "documents"))).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP2_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
