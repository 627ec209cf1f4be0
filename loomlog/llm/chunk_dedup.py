"""Operator 10: substring dedup by content-defined chunks.

A gear rolling hash over the UTF-8 bytes cuts a text where the hash is low, so an
insertion moves the cuts near it alone; chunks are of variable length (``MEAN``
bytes on average, at most ``LONGEST``). A first pass counts 64-bit digests of chunks;
those that occur twice fill a bitmap of bounded size. A second pass over the texts
keeps chunks in it, and of these the runs of neighbours that can be a passage (later
steps only take chunks away, so none is lost). They alone go through the exact step,
which counts 128-bit digests and names each one's first occurrence.

A run of repeated neighbours is a passage if it holds ``WORDS`` words (parted by any
white space) and reaches over ``PASSAGE`` words. Its reach counts the words back to
the cut before the run (and the ``SPAN`` bytes that a cut depends on) and on to the cut
behind it: where a repeated passage begins and ends lies between them, so each
passage of over 50 words reaches as far. One is missed only if fewer than ``WORDS`` of
its words lie in whole chunks of its own, some 0.1 % of those of 51 words; some of 43 to
50 words are reported, too. A stretch of one word over and over may hold no cut, and isn't
found then. Runs of ``WORDS`` words and more with one other chunk
between them are one passage, with a changed word or something put in, if they hold
over half of its reach. Scripts without white space count by ``LONG`` code points.

Each passage is told in spans. Spans with is_first false hold no chunk's first
occurrence: whoever drops all of them keeps every chunk once. They part where the
document that had their chunks first, or the place in it, changes for ``PIECE`` words or
more; shorter changes belong to the span around them. Chunks that aren't
first ones, for fewer than ``PIECE`` words between first ones, stay with those.

A passage that repeats within one text counts as well. Null texts count as empty
and have no passages; a null doc_id is the last to be first; repeated rows repeat each
other's whole texts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom, caches, common

MEAN, LONGEST = 24, 1024
PASSAGE, WORDS, PIECE = 50, 8, 22
#: Bytes that a cut depends on: the gear hash has as many bits, and each byte shifts it by one.
SPAN = 16

#: Runs of as many code points, with words of 12 and more on average, are passages: scripts without white space.
LONG, WIDE_WORD = 6 * PASSAGE, 12
SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
GEAR = np.random.default_rng(2016).integers(0, 1 << SPAN, 256, dtype=np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of GEAR of the last 16 bytes, each
    shifted by its age, taken by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    return h


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks, in bytes; the last is the text's end."""
    if not len(data):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(gear(data) < (1 << SPAN) // MEAN) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    sizes = np.diff(ends, prepend=0)
    if sizes.max() > LONGEST:
        ends = np.concatenate([np.append(np.arange(e - s + LONGEST, e, LONGEST), e) if s > LONGEST else [e] for e, s in zip(ends, sizes, strict=True)])
    return ends


def chunks(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends and digests of a text's chunks."""
    ends = cuts(np.frombuffer(raw, np.uint8))
    digest = xxhash.xxh3_64_intdigest
    at, out = 0, []
    for e in ends.tolist():
        out.append(digest(raw[at:e]))
        at = e
    return ends, np.array(out, np.uint64)


def _raw(column) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def spaces(data: np.ndarray) -> np.ndarray:
    """Whether each byte of a text belongs to white space, as str.split has it."""
    space = SPACE[data]
    if len(data) > 1 and data.max() > 0x7F:
        two = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        space[:-1] |= two
        space[1:] |= two
        a, b, c = data[:-2], data[1:-1], data[2:]
        three = (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        three |= (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        for k in range(3):
            space[k : len(space) - 2 + k] |= three
    return space


def _digests(batches):
    caches.only()
    for b in batches:
        found = [chunks(x)[1] for x in _raw(b.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(found) if found else np.empty(0, np.uint64)).view(np.int64))], names=["digest"])


SUSPECT = "rid long, doc_id long, at int, digest binary, start int, end int, words_before int, words_until int, reach_from int, reach_to int"


def _suspects(batches, bits, passage: int):
    """The chunks in the bitmap that stand in runs which can be passages."""
    caches.only()
    bitmap = np.frombuffer(bits.value, np.uint8)
    digest = xxhash.xxh3_128_digest
    for b in batches:
        rids, doc_ids, digests = [], [], []
        numbers: list[np.ndarray] = []
        for r, d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _raw(b.column(2)), strict=True):
            ends, short = chunks(raw)
            if not len(ends) or not (kept := bloom.test(bitmap, short)).any():
                continue
            data = np.frombuffer(raw, np.uint8)
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
            space = spaces(data)
            begun = np.concatenate(([0], np.cumsum(~space & np.concatenate(([True], space[:-1])))))  # words begun before each byte
            begins = np.concatenate(([0], ends[:-1]))
            reach_from = begun[np.maximum(np.concatenate(([0], begins[:-1])) - SPAN, 0)]
            reach_to = begun[np.concatenate((ends[1:], ends[-1:]))]
            first, last = _runs(kept)
            words = begun[ends[last]] - begun[begins[first]]
            one = _joined(first, last, words)
            words = np.bincount(one, words)[one]
            heads = np.flatnonzero(np.diff(one, prepend=-1))
            reach = np.maximum.reduceat(reach_to[last], heads)[one] - np.minimum.reduceat(reach_from[first], heads)[one]
            may = (words >= WORDS) & (reach + 1 > passage) | (points[ends[last]] - points[begins[first]] >= LONG)
            if not may.any():
                continue
            at = np.concatenate([np.arange(x, y + 1) for x, y in zip(first[may], last[may], strict=True)])
            rids.append(np.full(len(at), r, np.int64))
            doc_ids += [d] * len(at)
            digests += [digest(raw[x:y]) for x, y in zip(begins[at].tolist(), ends[at].tolist(), strict=True)]
            numbers.append(np.stack([at, points[begins[at]], points[ends[at]], begun[begins[at]], begun[ends[at]], reach_from[at], reach_to[at]]).astype(np.int32))
        held = np.concatenate(numbers, axis=1) if numbers else np.empty((7, 0), np.int32)
        columns = [pa.array(np.concatenate(rids) if rids else np.empty(0, np.int64)), pa.array(doc_ids, pa.int64()), pa.array(held[0]), pa.array(digests, pa.binary()), *map(pa.array, held[1:])]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SUSPECT.split(", ")])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of set flags."""
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edges > 0), np.flatnonzero(edges < 0) - 1


def _joined(first: np.ndarray, last: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The passage's number of each run (of one text, or parted by places far off):
    runs of ``WORDS`` words with one chunk between them are one."""
    near = (first[1:] - last[:-1] == 2) & (words[1:] >= WORDS) & (words[:-1] >= WORDS)
    return np.cumsum(np.concatenate(([False], ~near)))


KNOWN = ("rid", "doc_id", "at", "start", "end", "words_before", "words_until", "reach_from", "reach_to", "first_rid", "first_at", "first_doc_id")
PASSAGES = "rid long, doc_id long, start long, end long, n_words long, first_doc_id long, is_first boolean"


def _passages(batches, passage: int):
    """Rows (KNOWN) come sorted by rid and at; a text's rows are taken together."""
    caches.only()
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        rid = b.column(0).to_numpy()
        if held and rid[-1] != held[-1].column(0)[0].as_py():
            cut = int(np.searchsorted(rid, rid[-1]))
            yield _spans(pa.Table.from_batches([*held, b.slice(0, cut)]), passage)
            held = [b.slice(cut)]
        elif held:
            held.append(b)
        else:
            cut = int(np.searchsorted(rid, rid[-1]))
            if cut:
                yield _spans(pa.Table.from_batches([b.slice(0, cut)]), passage)
            held = [b.slice(cut)]
    if held:
        yield _spans(pa.Table.from_batches(held), passage)


def _spans(rows: pa.Table, passage: int) -> pa.RecordBatch:
    rid, at, start, end, before, until, reach_from, reach_to, first_rid, first_at = (rows[x].to_numpy() for x in KNOWN if "doc_id" not in x)
    changes = lambda *x: np.concatenate(([True], np.logical_or.reduce([y[1:] != y[:-1] for y in x])))

    def ranges(new):
        a = np.flatnonzero(new)
        return a, np.append(a[1:], len(new)) - 1, np.cumsum(new) - 1

    new = changes(rid, at - np.arange(len(at)))
    a, z, run = ranges(new)
    words, chars = until[z] - before[a], end[z] - start[a]
    far = np.cumsum(changes(rid[a])) * (1 << 33)  # runs of two texts aren't near
    one = _joined(at[a] + far, at[z] + far, words)
    heads = np.flatnonzero(np.diff(one, prepend=-1))
    shared = np.bincount(one, words)[one]
    reach = np.maximum.reduceat(reach_to[z], heads)[one] - np.minimum.reduceat(reach_from[a], heads)[one] + 1
    whole = np.bincount(one)[one] == 1
    good = (shared >= WORDS) & (reach > passage) & (whole | (2 * shared > reach)) | (chars >= LONG) & (chars >= WIDE_WORD * words)
    # stretches of chunks that aren't first ones, long enough or whole runs, go
    later = (first_rid != rid) | (first_at != at)
    x, y, stretch = ranges(new | changes(later))
    goes = later[x] & ((until[y] - before[x] >= PIECE) | (end[y] - start[x] >= LONG) | ((x == a[run[x]]) & (y == z[run[x]])))
    goes = goes[stretch]
    # within these, where the origin changes for long enough
    shift = first_at.astype(np.int64) - at
    group = np.cumsum(new | changes(goes)) - 1
    x, y, piece = ranges(new | changes(goes) | goes & changes(first_rid, shift))
    size, own = until[y] - before[x], group[x]
    longest = np.lexsort((size, own))
    longest = longest[np.append(own[longest][1:] != own[longest][:-1], True)]  # of each group, by its number
    major = size >= PIECE
    order = np.arange(len(x))
    last = np.maximum.accumulate(np.where(major, order, -1))
    last = np.where((last >= 0) & (own[last] == own), last, -1)
    after = np.minimum.accumulate(np.where(major, order, len(x))[::-1])[::-1]
    after = np.where((after < len(x)) & (own[np.minimum(after, len(x) - 1)] == own), after, -1)
    origin = x[np.where(last >= 0, last, np.where(after >= 0, after, longest[own]))][piece]
    s, e, _ = ranges(new | changes(goes) | goes & changes(first_rid[origin], shift[origin]))
    keep = good[run[s]]
    s, e = s[keep], e[keep]
    doc_id, first_doc_id = (rows[x].combine_chunks() for x in ("doc_id", "first_doc_id"))
    first_doc = pc.if_else(pa.array(goes[s]), first_doc_id.take(pa.array(origin[s])), doc_id.take(pa.array(s)))
    r, p, q, n = (pa.array(v.astype(np.int64)) for v in (rid[s], start[s], end[e], until[e] - before[s]))
    columns = [r, doc_id.take(pa.array(s)), p, q, n, first_doc, pa.array(~goes[s])]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PASSAGES.split(", ")])


def repeated(rows: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """rid, doc_id, start, end (code points), n_words, first_doc_id, is_first of every
    span of a repeated passage; rows: rid, doc_id, text (no nulls)."""
    spark = rows.sparkSession
    common.prepare(spark)
    counted = rows.select("text").mapInArrow(_digests, "digest long").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    twice = common.materialise(counted, "repeated-digests")
    bits = spark.sparkContext.broadcast(bloom.build(twice, twice.count(), least=1))
    held = common.materialise(rows.select("rid", "doc_id", "text").mapInArrow(lambda x: _suspects(x, bits, passage), SUSPECT), "suspects")
    groups = held.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid", "at")).alias("first")).where("n > 1")
    known = common.attach(held, common.materialise(groups, "digests"), "digest", "n", held.count())
    known = known.select(*KNOWN[:-3], F.col("first.rid").alias("first_rid"), F.col("first.at").alias("first_at"), F.col("first.doc_id").alias("first_doc_id"))
    return known.repartition("rid").sortWithinPartitions("rid", "at").mapInArrow(lambda x: _passages(x, passage), PASSAGES)


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all repeated passages of all documents."""
    docs = common.with_row_id(common.table(spark, sf_dir, "documents"), "rid")
    rows = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    return repeated(rows).select("doc_id", "start", "end", "n_words", "first_doc_id", "is_first")
