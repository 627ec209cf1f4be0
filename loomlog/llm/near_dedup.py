"""Operator 4: n-gram Jaccard join by MinHash bands.

Texts are sets of five-word shingles; two are linked at a Jaccard similarity of 0.8
or more. Bands and rows are chosen so that a pair at the threshold shares a band with
the target recall (0.999). Rows with one set ("copies") are represented by one of
them. Representatives are shuffled by band hash; each bucket ties its members to its
least one, and the ties' components are the candidates' groups. Every pair in a group is
verified on the full sets. A group's texts meet its first one ("base") in parts of
``PART`` rows, once; from there on a set is its size and its difference from the base's,
which loses nothing (the difference of two sets is that of their differences) and is
small for near copies. Blocks of at most ``BLOCK`` texts and some ``BLOCK_BYTES`` of differences are
paired, so no task gathers a group, and pairs come from matrix products over what
occurs twice among the differences; groups beyond ``WIDE`` texts are verified bucket by
bucket in such blocks, a pair counting in the first band that it shares. Tasks return counts of links and a forest of them, so what
they emit grows with the texts, not with the pairs, and no link is lost.

Result: per row its class (least doc_id among those connected by links), the size of the
class, how many other documents it is linked to, and whether it stays (the first one
of its class does).

A null text or one without words has no shingles and is a class of its own; texts of
fewer than five words have one shingle; a null doc_id is the last to stay; repeated
rows are copies; an empty table gives an empty result; further columns are ignored
here and kept by ``near_dedup``.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caches, common, shingles
from .components import components

THRESHOLD = 0.8
BLOCK, BLOCK_BYTES = 256, 8 << 20
PART = 256
WIDE = 8192


def _sign(batches):
    caches.only("shingles")
    sign = shingles.MinHash(THRESHOLD)
    for b in batches:
        out: dict[str, list] = {x: [] for x in ("set", "bands")}
        for text in b.column(2).to_pylist():
            own = shingles.distinct(text)
            out["set"].append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            out["bands"].append(sign(own).view(np.int64) if len(own) else [])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out["set"], pa.binary()), pa.array(out["bands"], pa.list_(pa.int64()))], names=["rid", "doc_id", "set", "bands"])


def signatures(rows: DataFrame) -> DataFrame:
    """rid, doc_id, set (digest of the shingles, null if none), bands; rows: rid, doc_id, text."""
    common.prepare(rows.sparkSession)
    return common.materialise(rows.select("rid", "doc_id", "text").mapInArrow(_sign, "rid long, doc_id long, set binary, bands array<long>"), "signatures")


def _pairs(rids: np.ndarray, sizes: np.ndarray, differences: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each left text is linked to each right one; differences: from one base."""
    lengths = np.array([len(x) for x in differences], np.int64)
    owner = np.repeat(np.arange(len(differences)), lengths)
    _, inverse, counts = np.unique(np.concatenate(differences), return_inverse=True, return_counts=True)
    common_ = counts[inverse] > 1
    column = (np.cumsum(counts > 1) - 1)[inverse[common_]]
    owner = owner[common_]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (at, at + width))
        m = np.zeros((len(differences), width), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        both += m[left] @ m[right].T
    apart = lengths[left][:, None] + lengths[right][None, :] - 2 * both.astype(np.int64)
    whole = (sizes[left][:, None] + sizes[right][None, :] + apart) // 2
    return (whole - apart >= THRESHOLD * whole - 1e-6) & (rids[left][:, None] != rids[right][None, :])


def _verify_group(rows: list[dict]):
    rids = np.array([x["rid"] for x in rows], np.int64)
    weight = np.array([x["copies"] for x in rows], np.int64)
    sizes = np.array([x["n"] for x in rows], np.int64)
    differences = [np.frombuffer(x["difference"], np.uint64) for x in rows]
    block = np.array([x["block"] for x in rows])
    if rows[0]["i"] == rows[0]["j"]:
        left = right = np.arange(len(rows))
    else:
        left, right = np.flatnonzero(block == rows[0]["i"]), np.flatnonzero(block == rows[0]["j"])
    if not len(left) or not len(right):
        return
    linked = _pairs(rids, sizes, differences, left, right)
    band = rows[0]["band"]
    new = linked
    if band > 0:  # pairs that share an earlier band were counted there
        bands = np.array([x["bands"][:band] for x in rows], np.int64)
        for k in range(band):
            new = new & (bands[left, k][:, None] != bands[right, k][None, :])
    links = np.zeros(len(rows), np.int64)
    links[left] += (new * weight[right][None, :]).sum(axis=1)
    if left is not right:
        links[right] += (new * weight[left][:, None]).sum(axis=0)
    root = rids.copy()
    while True:
        last = root.copy()
        far = np.iinfo(np.int64).max
        np.minimum.at(root, left, np.where(linked, root[right][None, :], far).min(axis=1))
        np.minimum.at(root, right, np.where(linked, root[left][:, None], far).min(axis=0))
        if (last == root).all():
            break
    for k in np.flatnonzero((links > 0) | (root != rids)):
        yield int(rids[k]), int(links[k]), int(root[k])


def _verify(batches):
    """Rows come sorted by group and pair of blocks."""
    caches.only()

    def rows():
        for b in batches:
            yield from b.to_pylist()

    out: list[tuple] = []
    for _, own in groupby(rows(), key=lambda x: (x["gid"], x["band"], x["i"], x["j"])):
        out.extend(_verify_group(list(own)))
        if len(out) >= 5000:
            yield _links(out)
            out = []
    yield _links(out)


def _links(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["rid", "links", "root"])


DIFFERENCE = "rid long, gid long, n int, difference binary"


def _differ(batches):
    """Rows come sorted by group and part, the base (its rid is null) before the others."""
    caches.only("shingles")
    base = np.empty(0, np.uint64)
    for b in batches:
        out: dict[str, list] = {x.split()[0]: [] for x in DIFFERENCE.split(", ")}
        for gid, rid, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            own = shingles.distinct(text)
            if rid is None:
                base = own
            else:
                for x, v in zip(out.values(), (rid, gid, len(own), np.setxor1d(own, base, assume_unique=True).tobytes()), strict=True):
                    x.append(v)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)})


def _differences(sized: DataFrame, rows: DataFrame) -> DataFrame:
    """rid, gid, n (size of the set), difference (from that of the group's first text), written down.

    sized: gid (the least rid of the group), rid, size."""
    parts = F.ceil(F.col("size") / PART).cast("int")
    held = sized.withColumn("part", F.pmod(F.xxhash64("rid"), parts).cast("int")).withColumn("parts", parts)
    texts = common.materialise(rows.select("rid", "text").join(held, "rid").select("gid", "rid", "part", "parts", "text"), "group-texts")
    bases = texts.where("rid = gid").select("gid", F.lit(None).cast("long").alias("rid"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "text")
    dealt = texts.select("gid", "rid", "part", "text").unionByName(bases).repartition("gid", "part").sortWithinPartitions("gid", "part", F.col("rid").asc_nulls_first())
    return common.materialise(dealt.select("gid", "rid", "text").mapInArrow(_differ, DIFFERENCE), "differences")


def _blocks(members: DataFrame) -> DataFrame:
    """members: gid, band, rid, size and bytes of the group. A row for each pair of blocks that the member is in.

    Blocks are dealt by a hash, so their number alone is needed, not their order."""
    n = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = members.withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("n")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return other.select("gid", "band", "rid", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _summed(members: DataFrame, total: int) -> DataFrame:
    """members (gid, band, rid, size, weight) with ``bytes``, the sum of the group's weights."""
    groups = members.groupBy("gid").agg(F.sum("weight").alias("bytes"), F.max("size").alias("_size"))
    return common.attach(members, groups, "gid", "_size", total)


def _verified(members: DataFrame, reps: DataFrame, differences: DataFrame) -> DataFrame:
    """rid, links, root of the links within the members' groups."""
    held = members.join(reps.select("rid", "copies", "bands"), "rid")
    rows = held.join(differences.select("rid", F.col("n").cast("long").alias("n"), "difference"), "rid").select("gid", "band", "i", "j", "block", "rid", "copies", "bands", "n", "difference")
    dealt = rows.repartition("gid", "band", "i", "j").sortWithinPartitions("gid", "band", "i", "j")
    return dealt.mapInArrow(_verify, "rid long, links long, root long")


def links(rows: DataFrame) -> DataFrame:
    """rid, doc_id, class_id, class_size, n_links, kept of each row; rows: rid, doc_id, text."""
    signed = signatures(rows)
    total = signed.count()
    sets = common.materialise(signed.where("set is not null").groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid", "bands")).alias("first"), F.count("*").alias("copies")), "sets")
    reps = sets.select(F.col("first.rid").alias("rid"), "copies", F.col("first.bands").alias("bands"))
    buckets = reps.select("rid", F.posexplode_outer("bands").alias("band", "hash"))
    least = buckets.groupBy("hash").agg(F.min("rid").alias("low"), F.count("*").alias("size")).where("size > 1")
    least = common.materialise(least, "buckets")
    ties = common.attach(buckets, least, "hash", "size", total * shingles.MinHash(THRESHOLD).bands).select("rid", "low", "hash", "band", "size")
    ties = common.materialise(ties, "ties")
    groups = components(ties.select(F.col("rid").alias("a"), F.col("low").alias("b")))
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    sized = common.materialise(common.attach(groups, sizes, "component", "size", total).select(F.col("component").alias("gid"), F.col("node").alias("rid"), "size"), "groups")
    differences = _differences(sized, rows)
    weighed = sized.join(differences.select("rid", F.length("difference").cast("long").alias("weight")), "rid")
    members = _blocks(_summed(weighed.where(F.col("size") <= WIDE).withColumn("band", F.lit(-1)), total))
    wide = weighed.where(F.col("size") > WIDE).select("rid", "weight")
    if wide.take(1):
        buckets = ties.join(wide, "rid").select(F.col("hash").alias("gid"), F.col("band").cast("int").alias("band"), "rid", "size", "weight")
        members = members.unionByName(_blocks(_summed(buckets, total * shingles.MinHash(THRESHOLD).bands)))
    found = common.materialise(_verified(members, reps, differences), "links")
    classes = common.materialise(components(found.select(F.col("rid").alias("a"), F.col("root").alias("b"))), "classes")
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    labelled = (
        sets.select("set", "copies", F.col("first.rid").alias("rid"))
        .join(counts, "rid", "left").join(classes.withColumnRenamed("node", "rid"), "rid", "left")
        .select("set", "copies", F.coalesce("component", "rid").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    labelled = common.materialise(labelled, "labelled")
    alone = signed.where("set is null").select("rid", "doc_id", F.lit(0).cast("long").alias("n_links"), F.col("rid").alias("class"))
    told = common.materialise(common.attach(signed.where("set is not null").select("rid", "doc_id", "set"), labelled, "set", "copies", total).select("rid", "doc_id", "n_links", "class").unionByName(alone), "told")
    tops = told.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("top"), F.count("*").alias("class_size"))
    return common.attach(told, tops, "class", "class_size", total).select("rid", "doc_id", F.col("top.doc_id").alias("class_id"), "class_size", "n_links", (F.col("rid") == F.col("top.rid")).alias("kept"))


def _rows(docs: DataFrame) -> DataFrame:
    return _numbered_rows(common.with_row_id(docs))


def _numbered_rows(numbered: DataFrame) -> DataFrame:
    return numbered.select(F.col(common.RID).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of each class, all columns as they were."""
    numbered = common.with_row_id(docs)
    gone = common.materialise(links(_numbered_rows(numbered)).where("not kept").select(F.col("rid").alias(common.RID)), "gone")
    return common.but_for(numbered, gone)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: each document's class and number of links."""
    return links(_rows(common.table(spark, sf_dir, "documents"))).drop("rid")
