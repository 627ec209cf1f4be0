"""Operator 9: token ids in files of independent zstandard frames.

A file is a run of zstandard frames, each with the ids of whole documents as
little-endian unsigned 32-bit integers; then a skippable frame with an index of
the documents; then a skippable frame with the seek table: for each frame its
compressed size, its size and the low 32 bits of xxHash64 of its content, and
a footer (count of frames, descriptor with the checksum bit, magic number). This
is the public seekable layout, so that plain decoders read the files too, and a
reader finds a document by the footer, the table and one frame.

Documents are dealt to files by ranges of doc_id (and of the text's hash, should
many rows have one doc_id) and sorted, so names in order
give ascending ids. A file is written under a name of the attempt and renamed
when it is whole; a repeated attempt writes the same bytes. Drafts of lost attempts have
names that begin with a dot, and ``sweep`` removes them when the files are written.

Null texts count as empty and have the end id alone; null doc_ids come first;
repeated doc_ids are all written, in an order of their texts' hashes; an empty
table gives no file. Further columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Fixed values of the seekable layout.
SKIP_INDEX, SKIP_TABLE, SEEKABLE, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

INDEX = pa.schema([("doc_id", pa.int64()), ("frame", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "file string, part int, docs long, tokens long"


class Corrupt(ValueError):
    """A checksum, a size or a magic number is wrong."""


class Writer:
    """add() documents in order, then close(). out: a binary file open for writing."""

    def __init__(self, out, frame_bytes: int = 1 << 20, level: int = 3):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.frames: list[tuple[int, int, int]] = []
        self.index: dict[str, list] = {x: [] for x in INDEX.names}
        self.held: list[bytes] = []
        self.size = 0

    def add(self, doc_id, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._flush()
        for name, x in zip(INDEX.names, (doc_id, len(self.frames), self.size // 4, len(ids) // 4), strict=True):
            self.index[name].append(x)
        self.held.append(ids)
        self.size += len(ids)

    def _flush(self) -> None:
        import xxhash

        raw = b"".join(self.held)
        frame = self.compress(raw)
        self.out.write(frame)
        self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        with io.BytesIO() as held:
            with pa.ipc.new_stream(held, INDEX) as w:
                w.write_table(pa.table(self.index, schema=INDEX))
            index = self.compress(held.getvalue())
        self.out.write(struct.pack("<II", SKIP_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.frames)
        table += struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIP_TABLE, len(table)) + table)


class Reader:
    """Opens a file by its tail; frame(k) reads and checks that frame alone."""

    def __init__(self, source):
        import zstandard

        self.source = source
        self.decompress = zstandard.ZstdDecompressor().decompress
        source.seek(0, 2)
        end = source.tell()
        if end < 17:
            raise Corrupt("too short")
        n, descriptor, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or descriptor != CHECKSUMS:
            raise Corrupt("no seek table")
        start = end - 9 - 12 * n - 8
        table = self._at(start, 8 + 12 * n)
        if struct.unpack("<II", table[:8]) != (SKIP_TABLE, 12 * n + 9):
            raise Corrupt("seek table's frame")
        self.frames, at = [], 0
        for size, raw, checksum in struct.iter_unpack("<III", table[8:]):
            self.frames.append((at, size, raw, checksum))
            at += size
        head = struct.unpack("<II", self._at(at, 8))
        if head[0] != SKIP_INDEX or at + 8 + head[1] != start:
            raise Corrupt("index frame")
        self.index = pa.ipc.open_stream(self.decompress(self._at(at + 8, head[1]))).read_all()

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        got = self.source.read(size)
        if len(got) != size:
            raise Corrupt("cut short")
        return bytes(got)

    def frame(self, k: int) -> bytes:
        import xxhash

        at, size, raw, checksum = self.frames[k]
        data = self.decompress(self._at(at, size), max_output_size=max(raw, 1))
        if len(data) != raw or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise Corrupt(f"frame {k}")
        return data

    def documents(self, wanted: set | None = None):
        """(doc_id, ids) in order; with ``wanted`` only those, and only their frames."""
        held, data = -1, b""
        for doc_id, k, at, n in zip(*(self.index[x].to_pylist() for x in INDEX.names), strict=True):
            if wanted is None or doc_id in wanted:
                if k != held:
                    held, data = k, self.frame(k)
                yield doc_id, data[4 * at : 4 * (at + n)]


def _publish(system, draft: str, path: str) -> None:
    """Give a whole file its name. Where a lost attempt has left it there, it is the same bytes,
    and file systems that don't rename onto a file keep that one."""
    from pyarrow import fs

    try:
        system.move(draft, path)
    except OSError:
        there, own = system.get_file_info([path, draft])
        if there.type != fs.FileType.File or own.type == fs.FileType.File and there.size != own.size:
            raise
        if own.type == fs.FileType.File:
            system.delete_file(draft)


def _write(batches, folder: str, tokenizer: str, end_id: int, frame_bytes: int, call: str):
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    task = TaskContext.get()
    encode = tokens.encoder(tokenizer, call).encode
    end = struct.pack("<I", end_id)
    name = f"part-{task.partitionId():06d}.ids.zst"
    draft = f"{base}/.{name}.{task.taskAttemptId()}"
    docs = total = 0
    writer = out = None
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if writer is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(draft)
                writer = Writer(out, frame_bytes)
            ids = encode(text) + end
            writer.add(doc_id, ids)
            docs, total = docs + 1, total + len(ids) // 4
    if writer is not None:
        writer.close()
        out.close()
        _publish(system, draft, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "part": pa.array([task.partitionId()], pa.int32()), "docs": [docs], "tokens": [total]})


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, frame_bytes: int = 1 << 20) -> DataFrame:
    """Write docs' texts; returns the manifest, one row a file, itself written down."""
    common.prepare(docs.sparkSession)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
        .withColumn("hash", F.xxhash64("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("hash"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("hash"))
        .select("doc_id", "text")
    )
    call = uuid.uuid4().hex
    manifest = common.materialise(ordered.mapInArrow(lambda x: _write(x, folder, tokenizer, end_id, frame_bytes, call), MANIFEST), "manifest")
    sweep(folder)
    return manifest


def sweep(folder: str) -> int:
    """Remove what attempts that didn't end have left in the folder, and count it."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    if system.get_file_info([base])[0].type != fs.FileType.Directory:
        return 0
    drafts = [x.path for x in system.get_file_info(fs.FileSelector(base)) if x.base_name.startswith(".part-")]
    for path in drafts:
        system.delete_file(path)
    return len(drafts)


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _read(batches):
    for batch in batches:
        for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            with _open(uri) as source:
                for doc_id, ids in Reader(source).documents():
                    for x, value in zip(rows.values(), (doc_id, base, len(ids) // 4, zlib.crc32(ids)), strict=True):
                        x.append(value)
                    base += len(ids) // 4
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, from the files, every frame's checksum tested. The running sum
    over files takes one row a file."""
    common.prepare(manifest.sparkSession)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base"))
    tasks = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return placed.repartition(tasks, "file").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, doc_ids: set) -> dict:
    """The ids of a few documents, decompressing only their frames."""
    found = {}
    for row in manifest.select("file").toLocalIterator():
        with _open(row.file) as source:
            found |= dict(Reader(source).documents(set(doc_ids)))
    return found


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents, end id 2, read back from the files."""
    manifest = write_token_files(common.table(spark, sf_dir, "documents"), common.shared_dir(spark, "token-files"), tokens.tokenizer_path(), 2)
    return read_token_files(manifest)
