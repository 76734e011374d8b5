"""Token-id files: independent zstandard frames and a trailing seek table.

A file is the public seekable form of the zstandard format:

* data frames: each the ids of one run of tokens, little-endian, compressed on its own;
* a skippable frame (magic 0x184D2A50) with the document index: one compressed array
  of ``doc_id`` (int64), ``known`` (0 for a null id) and ``n_tokens``;
* a skippable frame (magic 0x184D2A5E) with the seek table: for every data frame its
  compressed size, its plain size and the low 32 bits of the XXH64 of its plain bytes,
  then the frame count, a descriptor byte and the closing magic 0x8F92EAB1.

A reader fetches the end of the file, the index, and then only the frames that hold the
tokens it is asked for; each is checked against its checksum. A document longer than a
frame spans several, short ones share one.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, new_shared_path
from .common import partitions, ship, tidy
from .tokens import default_tokenizer, encoder, slices

FRAME_BYTES = 1 << 18
FILE_TOKENS = 1 << 25
# Fixed values of the seekable format.
INDEX_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
END_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80


class Writer:
    """Writes one file; documents are appended in order."""

    def __init__(self, out: BinaryIO, dtype: np.dtype, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        self.out, self.dtype, self.frame_bytes = out, np.dtype(dtype), frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.buffer = bytearray()
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.n_tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append((0 if doc_id is None else doc_id, doc_id is not None, n))
        self.n_tokens += n
        self.buffer += ids
        while len(self.buffer) >= self.frame_bytes:
            self._frame(self.frame_bytes)

    def _frame(self, size: int) -> None:
        plain = bytes(self.buffer[:size])
        del self.buffer[:size]
        packed = self.zstd.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.buffer:
            self._frame(len(self.buffer))
        index = self.zstd.compress(np.array(self.docs, "<i8").reshape(-1, 3).tobytes())
        head = struct.pack("<BI", self.dtype.itemsize, len(self.docs))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(head) + len(index)) + head + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), CHECKSUMS, END_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table) + len(foot)) + table + foot)


class Reader:
    """Reads documents of one file by their place, decompressing only their frames."""

    def __init__(self, source: BinaryIO) -> None:
        self.source = source
        self.zstd = zstandard.ZstdDecompressor()
        end = source.seek(0, io.SEEK_END)
        n, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != END_MAGIC:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.checks = table[:, 2]
        self.offsets = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.plain = np.concatenate([[0], np.cumsum(table[:, 1], dtype=np.int64)])
        at = int(self.offsets[-1])
        magic, size = struct.unpack("<II", self._at(at, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index before the seek table")
        body = self._at(at + 8, size)
        width, docs = struct.unpack("<BI", body[:5])
        self.dtype = np.dtype(f"<u{width}")
        self.index = np.frombuffer(self.zstd.decompress(body[5:]), "<i8").reshape(docs, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.index[:, 2])])
        self.frames_read = 0
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            plain = self.zstd.decompress(self._at(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k])))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != int(self.checks[k]):
                raise ValueError(f"frame {k} fails its checksum")
            self.frames_read += 1
            self._last = (k, plain)
        return self._last[1]

    def __len__(self) -> int:
        return len(self.index)

    def doc_id(self, i: int) -> int | None:
        return int(self.index[i, 0]) if self.index[i, 1] else None

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        size = self.dtype.itemsize
        a, b = int(self.starts[i]) * size, int(self.starts[i + 1]) * size
        parts = []
        k = int(np.searchsorted(self.plain, a, side="right")) - 1
        while a < b:
            stop = min(b, int(self.plain[k + 1]))
            base = int(self.plain[k])
            parts.append(self.frame(k)[a - base : stop - base])
            a, k = stop, k + 1
        return np.frombuffer(b"".join(parts), self.dtype)

    def find(self, wanted: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Places and ids of the documents whose id is wanted."""
        for i in np.flatnonzero(np.isin(self.index[:, 0], list(wanted)) & (self.index[:, 1] == 1)):
            yield int(i), self.ids(int(i))


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return fs.LocalFileSystem(), uri


def write_token_files(
    docs: DataFrame,
    folder: str | None = None,
    tokenizer: str | None = None,
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    frame_bytes: int = FRAME_BYTES,
) -> DataFrame:
    """Write ids of all documents in ascending order of id; return the manifest.

    The manifest has one row per file, in order: ``part``, ``path``, ``n_docs``,
    ``n_tokens`` and ``start``, the tokens of all files before it. Texts are range
    partitioned and sorted by id (null first; equal ids by a hash of the text), so no
    task holds more than its range. A task writes under a name of its own; only the
    files in the manifest count, so a task that runs twice leaves an unread file and
    no wrong result. Null texts are empty; an empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or default_tokenizer()
    base = (folder or new_shared_path(spark, "tokens")).rstrip("/")
    order = ["__id", "__th"]
    rows = docs.select(
        F.col(doc_id).cast("long").alias("__id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__th"),
        F.coalesce(F.col(text), F.lit("")).alias("__text"),
    )
    n = max(partitions(docs), 1)
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        files, _ = _filesystem(base)
        part = TaskContext.get().partitionId()
        done, sink, target, writer = [], None, "", None

        def finish() -> None:
            nonlocal sink, writer
            writer.close()
            sink.close()
            done.append((part, len(done), target, len(writer.docs), writer.n_tokens))
            sink = writer = None

        for b in slices(batches):
            if writer is None:
                target = f"{base}/part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.ztok"
                _, local = _filesystem(target)
                files.create_dir(local.rsplit("/", 1)[0], recursive=True)
                sink = files.open_output_stream(local)
                writer = Writer(sink, enc.dtype, frame_bytes)
            for i, ids in zip(b.column("__id").to_pylist(), enc.encode(b.column("__text").to_pylist()), strict=True):
                writer.add(i, ids + end)
            if writer.n_tokens >= FILE_TOKENS:
                finish()
        if writer is not None:
            finish()
        if done:
            names = ["part", "piece", "path", "n_docs", "n_tokens"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if k == 2 else pa.int64()) for k, c in enumerate(zip(*done, strict=True))],
                names=names,
            )

    found = rows.select("__id", "__text").mapInArrow(
        tidy(run, encodes=True), "part long, piece long, path string, n_docs long, n_tokens long"
    )
    manifest = cut_lineage(found)
    # One row per file: a few numbers per hundred megabytes of text.
    before = W.orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(
    spark: SparkSession, manifest: DataFrame, wanted: Sequence[int] | None = None, ids: bool = True
) -> DataFrame:
    """Documents of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and ``ids``.

    ``wanted`` names ids to read (a short list): only frames that hold them are
    decompressed. ``start`` counts the tokens of all documents before, over all files;
    ``ids`` and the checksum are of little-endian unsigned 32-bit numbers. ``ids=False``
    leaves the ids out.
    """
    ship(spark)
    chosen = None if wanted is None else list(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, first in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                files, local = _filesystem(place)
                with files.open_input_file(local) as source:
                    reader = Reader(source)
                    if chosen is None:
                        found = ((i, reader.ids(i)) for i in range(len(reader)))
                    else:
                        found = reader.find(chosen)
                    out: list[tuple] = []
                    held = 0
                    for i, x in found:
                        raw = x.astype("<u4").tobytes()
                        out.append(
                            (reader.doc_id(i), first + int(reader.starts[i]), len(x), zlib.crc32(raw))
                            + ((raw,) if ids else ())
                        )
                        held += len(raw) if ids else 64
                        if held > 1 << 23:
                            yield _documents(out, ids)
                            out, held = [], 0
                    if out:
                        yield _documents(out, ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")
    spread = manifest.select("path", "start").repartition(max(partitions(manifest), 1))
    return spread.mapInArrow(run, schema)


def _documents(rows: list[tuple], ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]
    types = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names
    )
