"""Operators 3 and 9 and the encoder: exact round trips."""

import collections
import io
import random
import zlib

import numpy as np
import pytest
from llm_words import prose
from pyspark.sql import functions as F

from loomlog.llm import common, packing, token_files, tokens

PATH = tokens.tokenizer_path()
TRICKY = [
    "", " ", "\n", "Ça va? İstanbul ΑΣ ﬁn éa <|endoftext|>x don't I'LL 12km ªº µm ŉ x y\x1cz ÀÉ’s O'Neil's  \n\n 漢字 😀", "ǅ ẞ Ÿ ÿ ß é ́a", "word, word. WORD!! Word### o'clock' a|b |", "a\tb c d",
    "x" * 500, "<|startoftext|>!", "'s 't 'RE abc's.", "﻿é‍😀", "1234567 3.14 ½ Ⅷ",
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def _ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_encoder_equals_the_library(spark, plain):
    encode = tokens.Encoder(PATH, most=2000).encode
    texts = TRICKY + [r.text for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    rng = random.Random(1)
    alphabet = "abcXYZéßÉñ'.,!# \n\t<|>09½漢́ 😀µª"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    for text in texts:
        assert _ids(encode(text)) == plain(text), text


def test_encoder_leaves_other_tokenizers_alone():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, whole = tokens.Encoder(path).encode, Tokenizer.from_file(path)
    for text in TRICKY:
        assert _ids(encode(text)) == whole.encode(text, add_special_tokens=False).ids


# -- 9


def _want(rows, plain, end):
    at, out = 0, []
    for doc_id, text in rows:
        ids = [*plain(text), end]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_op9_round_trip(spark, plain):
    d = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in common.table(spark, d, "documents").collect())
    got = sorted(map(tuple, token_files.op9_token_files(spark, d).collect()))
    assert got == _want(rows, plain, 2)


def test_op9_many_files_and_odd_rows(spark, make, odd, empty, plain):
    rng = random.Random(3)
    rows = [(k * 7 % 300, prose(rng, rng.randint(0, 90))) for k in range(300)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        manifest = token_files.write_token_files(make(rows).withColumn("n", F.lit(1)), common.shared_dir(spark, "t"), PATH, 2, frame_bytes=2000)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert manifest.count() > 1
    got = sorted(map(tuple, token_files.read_token_files(manifest).collect()))
    assert got == _want(sorted(rows), plain, 2)
    some = token_files.read_documents(manifest, {5, 77})
    assert {k: _ids(v) for k, v in some.items()} == {k: [*plain(dict(rows)[k]), 2] for k in (5, 77)}
    left = token_files.read_token_files(token_files.write_token_files(odd, common.shared_dir(spark, "t"), PATH, 2)).orderBy("start").collect()
    ids = [r.doc_id for r in left]
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and len(ids) == odd.count()
    assert [r.start for r in left] == np.cumsum([0, *(r.n_tokens for r in left)])[:-1].tolist()
    assert token_files.read_token_files(token_files.write_token_files(empty, common.shared_dir(spark, "t"), PATH, 2)).count() == 0


def _file(docs, **more):
    out = io.BytesIO()
    w = token_files.Writer(out, **more)
    for doc_id, ids in docs:
        w.add(doc_id, np.array(ids, "<u4").tobytes())
    w.close()
    return out


def test_op9_files_are_standard_and_checked():
    import zstandard

    docs = [(k, list(range(k * 10, k * 10 + 50))) for k in range(40)] + [(None, []), (99, [7])]
    out = _file(docs, frame_bytes=600)
    reader = token_files.Reader(out)
    assert [(d, _ids(x)) for d, x in reader.documents()] == docs and len(reader.frames) > 5
    plain = zstandard.ZstdDecompressor().stream_reader(out.getvalue(), read_across_frames=True).read()
    assert _ids(plain) == [x for _, ids in docs for x in ids]
    at = reader.frames[2][0] + reader.frames[2][1] - 3
    for damage in (lambda b: b.__setitem__(at, b[at] ^ 255), lambda b: b.__delitem__(slice(-4, None)), lambda b: b.__delitem__(slice(at, at + 9))):
        raw = bytearray(out.getvalue())
        damage(raw)
        with pytest.raises((token_files.Corrupt, zstandard.ZstdError, OSError)):
            list(token_files.Reader(io.BytesIO(bytes(raw))).documents())
    with pytest.raises(token_files.Corrupt):
        token_files.Reader(io.BytesIO(b"short"))
    reads = []

    class Counting(io.BytesIO):
        def read(self, n=-1):
            reads.append(n)
            return super().read(n)

    one = token_files.Reader(Counting(out.getvalue()))
    reads.clear()
    assert [d for d, _ in one.documents({20})] == [20] and len(reads) == 1


# -- 3


def _check(rows, pieces, plain, end=1, length=packing.LENGTH):
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for doc_id, text in rows:
        ids, at = np.array([*plain(text), end], "<u4"), 0
        for p in sorted(by[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[p.start : at].tobytes())
        assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for s, held in sequences.items():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or s == len(sequences) - 1 and at < length


def test_op3_every_id_once(spark, plain):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in common.table(spark, d, "documents").collect()]
    _check(rows, packing.op3_packing(spark, d).collect(), plain)


def test_op3_windows_hold_the_mixture(make):
    rng = random.Random(6)
    sources = ["hot"] * 6 + ["a", "b", "c"]
    rows = [(k, prose(rng, rng.randint(5, 200)), rng.choice(sources)) for k in range(900)]
    for targets in (None, {"hot": 0.25, "a": 0.25, "b": 0.25, "c": 0.25}):
        pieces = packing.pack(make(rows), PATH, 1, 64, 64, targets).collect()
        windows = collections.defaultdict(collections.Counter)
        total = collections.Counter()
        for p in pieces:
            windows[p.window][p.source] += p.length
            total[p.source] += p.length
        share = {s: n / sum(total.values()) for s, n in total.items()} if targets is None else targets
        drained = min(total[s] / share[s] for s in total) / (64 * 64)
        whole = [w for w in windows if w < int(drained)]
        assert len(whole) > 5
        for w in whole:  # off by a packet at most, carried over
            assert all(abs(windows[w][s] - share[s] * 64 * 64) <= 2 * 64 for s in total)


def test_op3_odd_rows(spark, odd, empty, plain):
    pieces = packing.pack(odd.withColumn("rid", F.lit(1)).withColumn("window", F.lit(1)), PATH, 1, 128).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    twice = {d for d, n in collections.Counter(d for d, _ in rows).items() if n > 1}
    assert sum(p.length for p in pieces) == sum(len(plain(t)) + 1 for _, t in rows)
    assert {p.doc_id for p in pieces} == {d for d, _ in rows}
    one = [p for p in pieces if p.doc_id not in twice]
    for doc_id, text in rows:
        if doc_id not in twice:
            ids = [x for p in sorted((p for p in one if p.doc_id == doc_id), key=lambda p: p.start) for x in _ids(p.ids)]
            assert ids == [*plain(text), 1]
    assert packing.pack(empty, PATH, 1).count() == 0
    assert [packing.padded_length(x) for x in (1, 5, 1024, 2047, 2048)] == [1, 2048, 1024, 2048, 2048]


def test_op3_windows_stay_full_when_queues_drain(make):
    rng = random.Random(7)
    rows = [(k, prose(rng, rng.randint(5, 120)), s) for k, s in enumerate(["big"] * 500 + ["mid"] * 200 + ["small"] * 60 + ["none"] * 40)]
    for targets in ({"big": 0.2, "mid": 0.4, "small": 0.4}, 0.5):
        pieces = packing.pack(make(rows), PATH, 1, 64, 32, targets).collect()
        windows, sequences = collections.defaultdict(collections.Counter), collections.defaultdict(set)
        for p in pieces:
            windows[p.window][p.source] += p.length
            sequences[p.sequence_id].add(p.source)
        assert all(sum(windows[w].values()) == 64 * 32 for w in windows if w != max(windows))
        if targets != 0.5:
            last = max(w for w in windows if windows[w]["small"])
            between = [w for w in windows if last < w < max(w for w in windows if windows[w]["mid"])]
            assert len(between) > 2 and all(abs(windows[w]["mid"] - 2 / 3 * 64 * 32) <= 2 * 64 for w in between)
            assert min(w for w in windows if windows[w]["none"]) >= max(w for w in windows if windows[w]["big"])
        assert sum(len(x) > 1 for x in sequences.values()) > len(sequences) / 4


def test_op3_many_sources_share_a_queue(make, monkeypatch):
    monkeypatch.setattr(packing, "MOST_QUEUES", 3)
    rng = random.Random(8)
    rows = [(k, prose(rng, 30), f"s{k % 9}" if k % 9 else None) for k in range(200)]
    pieces = packing.pack(make(rows), PATH, 1, 64, 4, 0.7).collect()
    assert {p.doc_id for p in pieces} == set(range(200)) and sorted({p.sequence_id for p in pieces}) == list(range(max(p.sequence_id for p in pieces) + 1))


def test_other_tokenizer_files_go_by_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    assert tokens._splits_at_spaces(spec)
    spec["normalizer"]["normalizers"].append({"type": "StripAccents"})
    path = str(tmp_path / "t.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    encoder, whole = tokens.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.split
    for text in TRICKY:
        assert _ids(encoder.encode(text)) == whole.encode(text, add_special_tokens=False).ids


def test_op9_an_earlier_attempts_file_stands(tmp_path):
    from pyarrow import fs

    class Refusing:
        """A file system that doesn't rename onto a file."""

        def __init__(self):
            self.own = fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.own, name)

        def move(self, a, b):
            if self.own.get_file_info([b])[0].type == fs.FileType.File:
                raise OSError("exists")
            self.own.move(a, b)

    system, path, draft = Refusing(), str(tmp_path / "part-0"), str(tmp_path / ".part-0.1")
    for content in (b"same", b"same"):
        with open(draft, "wb") as f:
            f.write(content)
        token_files._publish(system, draft, path)
    with open(draft, "wb") as f:
        f.write(b"another")
    with pytest.raises(OSError):
        token_files._publish(system, draft, path)
    assert token_files.sweep(f"file://{tmp_path}") == 1 and token_files.sweep(f"file://{tmp_path}/none") == 0
    with open(path, "rb") as f:
        assert f.read() == b"same"
