"""Operators 2, 4 and 10 against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import oracle
import pytest
from llm_words import WORDS, prose
from pyspark.sql import functions as F

from loomlog.llm import bloom, chunk_dedup, common, components, exact_dedup, near_dedup, shingles


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- 2


def test_op2_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    want, got = oracle.compare(oracle.connect(d), exact_dedup.OP2_SQL, exact_dedup.op2_exact_dedup(spark, d))
    assert got == want


def test_op2_odd_rows(odd, empty, clashing):
    got = [tuple(r) for r in exact_dedup.decide(exact_dedup.fingerprints(odd)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha"))).collect()]
    groups = collections.defaultdict(list)
    for r in odd.collect():
        groups[hashlib.sha256(_lower(r.text).encode()).hexdigest()].append(r.doc_id)
    want = collections.Counter((d, max((x for x in ids if x is not None), default=None), len(ids), s) for s, ids in groups.items() for d in ids)
    assert collections.Counter((a, b, c, e) for a, b, c, _, e in got) == want
    assert sum(k for *_, k, _ in got) == len(groups)
    assert exact_dedup.decide(exact_dedup.fingerprints(empty)).count() == 0
    for df in (odd, clashing):
        left = exact_dedup.exact_dedup(df)
        assert left.columns == df.columns and left.count() == len(groups)
        assert len({_lower(r.text) for r in left.collect()}) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_hot_groups_are_decided(spark, make, monkeypatch):
    monkeypatch.setattr(common, "hot_limit", lambda n: 5)
    rows = [(k, "hot text" if k % 2 else f"text {k % 10}") for k in range(100)]
    got = {r.doc_id: r for r in exact_dedup.decide(exact_dedup.fingerprints(make(rows))).collect()}
    assert got[1].group_size == 50 and got[1].keep_id == 99 and sum(r.kept for r in got.values()) == 6


@pytest.mark.parametrize("least", [1, 2])
def test_bloom_has_no_false_negative(spark, least):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    keys = keys.unionByName(keys.where("pmod(key, 7) = 0"))
    bits = np.frombuffer(bloom.build(keys, keys.count(), least=least), np.uint8)
    held = np.array([r.key for r in keys.distinct().collect()], np.int64).view(np.uint64)
    twice = np.array([x.item() for x in held.view(np.int64)]) % 7 == 0
    found = bloom.test(bits, held)
    assert found.all() if least == 1 else found[twice].all() and found[~twice].mean() < 0.05
    other = np.array([r[0] for r in spark.range(5000, 10000).select(F.xxhash64("id")).collect()], np.int64).view(np.uint64)
    assert bloom.test(bits, other).mean() < 0.05


def test_full_bloom_changes_nothing(spark, make, monkeypatch):
    monkeypatch.setattr(bloom, "cells", lambda n, per_key=12, most_bits=0: bloom.CHUNK_BITS)
    rows = [(k, f"text {k // 3}") for k in range(3000)]
    got = exact_dedup.decide(exact_dedup.fingerprints(make(rows)))
    assert got.where("kept").count() == 1000 and got.where("group_size <> 3").count() == 0


# -- 4


def _sets(texts):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def _brute(sets):
    links, top = collections.defaultdict(set), {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a].add(b), links[b].add(a)
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (find(i), len(links[i])) for i in ids}


def _near_rows(rng, groups=12, size=6, n=120):
    rows, k = [], 0
    for g in range(groups):
        base = prose(rng, n).split()
        for _ in range(size):
            w = list(base)
            for at in rng.sample(range(n), rng.choice((0, 0, 1, 2, 3, 4))):
                w[at] = rng.choice(WORDS)
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k + j, prose(rng, 60)) for j in range(30)]
    return rows


@pytest.mark.parametrize(("block", "wide"), [(256, 8192), (4, 8192), (4, 3)])
def test_op4_equals_all_pairs(make, monkeypatch, block, wide):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "WIDE", wide)
    rows = _near_rows(random.Random(3))
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dedup.links(near_dedup._rows(make(rows))).collect()}
    assert got == _brute(_sets(rows))


def test_op4_one_large_group(make):
    rng = random.Random(8)
    base = prose(rng, 200).split()
    rows = []
    for k in range(700):
        w = list(base)
        for at in rng.sample(range(200), rng.randint(0, 3)):
            w[at] = rng.choice(WORDS)
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dedup.links(near_dedup._rows(make(rows))).collect()}
    assert got == _brute(_sets(rows))


def test_op4_odd_rows(odd, empty, clashing):
    got = near_dedup.links(near_dedup._rows(odd)).collect()
    assert len(got) == odd.count()
    same = [r for r in got if r.doc_id in (3, 4)]
    assert {(r.class_id, r.class_size, r.n_links) for r in same} == {(3, 3, 2)} and sum(r.kept for r in same) == 1
    assert all(r.kept and r.n_links == 0 for r in got if r.doc_id in (1, 2, 7))
    assert near_dedup.links(near_dedup._rows(empty)).count() == 0
    left = near_dedup.near_dedup(clashing)
    assert left.columns == clashing.columns and left.count() == odd.count() - 2
    assert near_dedup.near_dedup(empty).count() == 0


def test_minhash_bands_meet_the_recall():
    sign = shingles.MinHash(0.8, 0.999)
    assert sign.rows * sign.bands <= 128 and 1 - (1 - 0.8**sign.rows) ** sign.bands >= 0.999
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        a, b = base[:500], np.concatenate((base[:445], base[800:855]))  # 445 / 555
        met += bool((sign(a) == sign(b)).any())
    assert met >= 297


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 400)] + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(50)] + [(5000, 5000)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 10


def test_gear_is_the_rolling_sum():
    data = np.random.default_rng(0).integers(0, 256, 500, dtype=np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(chunk_dedup.GEAR[b])) & 0xFFFF
        want.append(h)
    assert chunk_dedup.gear(data).tolist() == want


def test_chunks_resist_insertions_and_are_bounded():
    rng = random.Random(4)
    raw = prose(rng, 2000).encode()
    a = set(chunk_dedup.chunks(raw)[1].tolist())
    b = set(chunk_dedup.chunks(raw[:3000] + b"inserted words " + raw[3000:])[1].tolist())
    assert len(a - b) <= 4
    for x in (raw, b"a" * 10_000, b"", b"q"):
        ends = chunk_dedup.chunks(x)[0]
        assert (ends[-1] if len(ends) else 0) == len(x) and np.diff(ends, prepend=0).max(initial=0) <= chunk_dedup.LONGEST


def test_op10_finds_every_shared_passage(make):
    rng = random.Random(6)
    passages = [prose(rng, rng.randint(51, 90)) for _ in range(40)]
    rows = [(k, prose(rng, rng.randint(30, 300))) for k in range(200)]
    planted = set()
    for p in passages:
        for k in rng.sample(range(200), 2):
            w = rows[k][1].split()
            at = rng.randrange(len(w))
            rows[k] = (k, " ".join([*w[:at], p, *w[at:]]))
            planted.add(k)
    line = "a repeated line of nine words stands at the end"
    rows = [(k, f"{t}\n{line}") for k, t in rows]
    got = chunk_dedup.repeated(common.with_row_id(make(rows), "rid").select("rid", "doc_id", "text")).collect()
    assert {r.doc_id for r in got} == planted
    texts = dict(rows)
    for r in got:
        words = texts[r.doc_id][r.start : r.end].split()
        pieces = [" ".join(words[k : k + 20]) for k in range(1, len(words) - 20)]
        assert r.n_words >= chunk_dedup.WORDS and any(x in t for x in pieces for k, t in texts.items() if k != r.doc_id)
        assert not r.is_first or r.first_doc_id == r.doc_id


def test_op10_spaces_are_those_of_python():
    text = "".join(f"a{chr(k)}é" for k in range(1, 0x3100)) + "x😀"
    want = b"".join((b"\1" if x.isspace() else b"\0") * len(x.encode()) for x in text)
    assert chunk_dedup.spaces(np.frombuffer(text.encode(), np.uint8)).tobytes() == want
    assert all(chunk_dedup.spaces(np.frombuffer(x, np.uint8)).tolist() == [False] * len(x) for x in (b"", "é".encode(), b"x"))


def test_op10_passages_with_other_white_space_or_none(make):
    rng = random.Random(14)
    tabs, wide = "\t".join(prose(rng, 80).split()), "\u3000".join(prose(rng, 80).split())
    none = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(900))
    rows = [(2 * k + j, f"{prose(rng, 40)} {x} {prose(rng, 40)}") for k, x in enumerate((tabs, wide, none)) for j in range(2)]
    got = chunk_dedup.repeated(common.with_row_id(make(rows), "rid").select("rid", "doc_id", "text")).collect()
    assert {r.doc_id for r in got} == set(range(6))


def test_op10_odd_rows(odd, empty, make):
    rows = lambda df: common.with_row_id(df, "rid").select("rid", "doc_id", common.text_of().alias("text"))
    assert chunk_dedup.repeated(rows(empty)).count() == 0
    assert {r.doc_id for r in chunk_dedup.repeated(rows(odd)).collect()} <= {5, 9}
    text = prose(random.Random(1), 80) + " é😀"
    twice = chunk_dedup.repeated(rows(make([(1, text), (1, text), (2, "x")]))).collect()
    assert [(r.doc_id, r.start, r.end) for r in twice] == [(1, 0, len(text))] * 2 and sorted(r.is_first for r in twice) == [False, True]


def _left(rows, spans):
    """(text number, digest) of the chunks that stay when the spans that aren't first go, and of those that go."""
    stay, gone = set(), set()
    for k, (_, text) in enumerate(rows):
        raw, at = text.encode(), 0
        own = [(a, b) for r, a, b in spans if r == k]
        for e in chunk_dedup.chunks(raw)[0].tolist():
            a, b = len(raw[:at].decode(errors="ignore")), len(raw[:e].decode(errors="ignore"))
            (gone if any(x <= a and b <= y for x, y in own) else stay).add(raw[at:e])
            at = e
    return stay, gone


def _numbered(spark, rows):
    return spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "rid long, doc_id long, text string")


def test_op10_what_is_dropped_stays_elsewhere(spark):
    rng = random.Random(21)
    x, y, z = prose(rng, 160), prose(rng, 70), prose(rng, 90)
    rows = [(1, f"{prose(rng, 30)} {x}"), (2, f"{x} {y}"), (3, f"{x} {y}"), (4, f"{y} {z} {prose(rng, 20)}"), (5, f"{z} {x} {z}"), (None, x), (5, y)]
    passages = [prose(rng, rng.randint(20, 120)) for _ in range(30)]
    for k in range(120):
        rows.append((10 + k // 2, " ".join([prose(rng, rng.randint(0, 40)), *rng.sample(passages, rng.randint(1, 4))])))
    got = chunk_dedup.repeated(_numbered(spark, rows)).collect()
    stay, gone = _left(rows, [(r.rid, r.start, r.end) for r in got if not r.is_first])
    assert gone and gone <= stay
    # X came first in document 1, Y in document 2
    assert {(r.doc_id, r.first_doc_id) for r in got if r.rid == 1} == {(2, 1), (2, 2)} and {r.first_doc_id for r in got if r.rid == 2} == {1, 2}
    assert not any(r.is_first for r in got if r.rid in (2, 5))
    for r in got:
        assert r.is_first <= (r.doc_id == r.first_doc_id) and 0 <= r.start < r.end <= len(rows[r.rid][1])
    by = collections.defaultdict(list)
    for r in got:
        by[r.rid].append((r.start, r.end))
    assert all(a[1] <= b[0] for own in by.values() for a, b in zip(sorted(own), sorted(own)[1:], strict=False))


def test_op10_finds_passages_of_51_words_and_leaves_short_ones(spark):
    rng = random.Random(22)
    rows, long = [], set()
    for k in range(1500):
        p = prose(rng, 51 if k % 2 else rng.randint(20, 35))
        for _ in range(2):
            if k % 2:
                long.add(len(rows))
            rows.append((len(rows), f"{prose(rng, 20)} {p} {prose(rng, 20)}"))
    found = {r.rid for r in chunk_dedup.repeated(_numbered(spark, rows)).collect()}
    short = set(range(len(rows))) - long
    assert len(found & long) >= 0.998 * len(long) and len(found & short) <= 0.02 * len(short)


def test_op4_blocks_by_bytes_and_parts(make, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(near_dedup, "PART", 3)
    rows = _near_rows(random.Random(11), groups=5, size=9, n=150)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dedup.links(near_dedup._rows(make(rows))).collect()}
    assert got == _brute(_sets(rows))
