"""Token-id files: independent zstandard frames, a checksum for each, and a seek table at the end.

A file is a run of data frames, then two skippable frames that any zstandard decoder passes over:

    data frame   ids of some consecutive documents: uint32 n; n x (int64 doc id, uint8 1 if that id is null, uint32 ids; a null
                 id is written as the least int64);
                 then all ids, little-endian, 2 or 4 bytes each
    documents    skippable 0x184D2A5C: uint8 bytes per id, uint32 n frames, then for each frame its first doc id
                 (int64), its documents (uint32) and its ids (uint64)
    seek table   skippable 0x184D2A5E of the public seekable format: for each frame compressed size, size and
                 checksum (low 32 bits of xxh64 of the content), then number of frames, descriptor 0x80, 0x8F92EAB1

A reader of one document reads the tail, finds the frame by its first id and decompresses that frame alone.

Documents are dealt by range of doc_id, so each task writes one file and files follow each other in doc_id order.  A
task writes to a name of its own attempt and moves the file when it is whole; the manifest, stored as a table, names the
file of the attempt that counted.  Lost executors cost their tasks again, nothing else.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latewing.llm import shared
from latewing.llm.tokenizing import encoder

#: Fixed values of the public seekable zstandard format.
SEEK_FRAME, SEEK_MAGIC, SEEK_CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
#: The skippable frame that this format adds.
DOCS_FRAME = 0x184D2A5C

#: Stands for a null id, which comes before all others.
_NULL = -(1 << 63)

_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_FRAME = np.dtype([("first", "<i8"), ("docs", "<u4"), ("ids", "<u8")])
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ids", "<u4")])


def _filesystem(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


@dataclass
class FrameWriter:
    """Appends documents to an open stream; a frame is closed when it holds ``frame_bytes`` of ids."""

    out: object
    width: int
    frame_bytes: int = 1 << 18
    level: int = 3
    entries: list = field(default_factory=list)
    frames: list = field(default_factory=list)
    docs: list = field(default_factory=list)
    parts: list = field(default_factory=list)
    held: int = 0
    total_ids: int = 0
    total_docs: int = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((_NULL if doc_id is None else doc_id, doc_id is None, len(ids)))
        self.parts.append(ids.astype(f"<u{self.width}").tobytes())
        self.held += len(self.parts[-1])
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        index = np.array(self.docs, _DOC)
        content = struct.pack("<I", len(index)) + index.tobytes() + b"".join(self.parts)
        packed = zstandard.ZstdCompressor(level=self.level).compress(content)
        self.out.write(packed)
        n = int(index["ids"].sum())
        self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.frames.append((self.docs[0][0], len(index), n))
        self.total_ids += n
        self.total_docs += len(index)
        self.docs, self.parts, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        n = len(self.entries)
        body = struct.pack("<BI", self.width, n) + np.array(self.frames, _FRAME).tobytes()
        self.out.write(struct.pack("<II", DOCS_FRAME, len(body)) + body)
        body = np.array(self.entries, _ENTRY).tobytes() + struct.pack("<IBI", n, SEEK_CHECKED, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(body)) + body)


class FrameReader:
    """Reads one file; ``open_at(offset, length)`` returns bytes of it."""

    def __init__(self, size: int, read_at: Callable[[int, int], bytes]):
        self.read_at = read_at
        n, kind, magic = struct.unpack("<IBI", read_at(size - 9, 9))
        if magic != SEEK_MAGIC or kind != SEEK_CHECKED:
            raise ValueError("no seek table at the end")
        at = size - 9 - n * _ENTRY.itemsize
        self.entries = np.frombuffer(read_at(at, n * _ENTRY.itemsize), _ENTRY)
        at -= 8 + 8 + 5 + n * _FRAME.itemsize  # both frame heads
        magic, _ = struct.unpack("<II", read_at(at, 8))
        if magic != DOCS_FRAME:
            raise ValueError("no table of documents before the seek table")
        self.width, _ = struct.unpack("<BI", read_at(at + 8, 5))
        self.frames = np.frombuffer(read_at(at + 13, n * _FRAME.itemsize), _FRAME)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"].astype(np.int64))])

    def frame(self, i: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The documents of frame i and their ids; raises on a wrong checksum."""
        entry = self.entries[i]
        packed = self.read_at(int(self.starts[i]), int(entry["packed"]))
        content = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(entry["size"]))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != int(entry["check"]):
            raise ValueError(f"frame {i} is damaged")
        (n,) = struct.unpack_from("<I", content)
        docs = np.frombuffer(content, _DOC, n, 4)
        ids = np.frombuffer(content, f"<u{self.width}", -1, 4 + n * _DOC.itemsize)
        return docs, np.split(ids, np.cumsum(docs["ids"].astype(np.int64))[:-1])

    def document(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document with this id, decompressing only frames that can hold it."""
        first = self.frames["first"]
        at = max(0, int(np.searchsorted(first, doc_id, "left")) - 1)
        found = []
        while at < len(first) and first[at] <= doc_id:
            docs, ids = self.frame(at)
            found += [ids[k] for k in np.flatnonzero((docs["doc_id"] == doc_id) & (docs["null"] == 0))]
            at += 1
        return found


def open_file(path: str) -> FrameReader:
    """A reader of a file by its URI; keeps the file open."""
    fs, inner = _filesystem(path)
    source = fs.open_input_file(inner)

    def read_at(offset: int, length: int) -> bytes:
        source.seek(offset)
        return source.read(length)

    return FrameReader(source.size(), read_at)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, files: int | None = None, frame_bytes: int = 1 << 18) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into token files under ``folder``; returns the manifest, stored as a table.

    Manifest: part, path, n_docs, n_tokens; parts follow each other in doc_id order, null ids first, rows with equal
    ids by a hash of their text.  Null and empty texts hold ``end_id`` alone.  An empty table writes one empty file per
    non-empty task, hence none.  Other columns of ``docs`` are not read.
    """
    n = files or max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    target = f"{folder}/tokens"
    fs, inner = _filesystem(target)
    fs.create_dir(inner, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, fs, out, name = None, None, None, ""
        encode = encoder(vocabulary)
        end = np.array([end_id], encode.dtype)
        for batch in shared.lean(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    fs, inner = _filesystem(target)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.tok"
                    out = fs.open_output_stream(f"{inner}/_{name}")
                    writer = FrameWriter(out, encode.dtype.itemsize, frame_bytes)
                writer.add(doc_id, np.concatenate([encode.encode(text.as_py()), end]))
        if writer is not None:
            writer.close()
            out.close()
            fs.move(f"{inner}/_{name}", f"{inner}/{name}")
            row = [[TaskContext.get().partitionId()], [f"{target}/{name}"], [writer.total_docs], [writer.total_ids]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["part", "path", "n_docs", "n_tokens"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "print").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "print")
    manifest = dealt.select("doc_id", "text").mapInArrow(write, "part bigint, path string, n_docs bigint, n_tokens bigint")
    return shared.stored(manifest, folder, "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files in a manifest: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Each task reads whole files frame by frame; sums over the manifest, one row per file, give each file's start.
    """
    import zlib

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("part", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("file_start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.lean(batches):
            for path, start in zip(batch.column("path").to_pylist(), batch.column("file_start").to_pylist(), strict=True):
                reader = open_file(path)
                for i in range(len(reader.entries)):
                    docs, ids = reader.frame(i)
                    n = docs["ids"].astype(np.int64)
                    starts = start + np.cumsum(n) - n
                    start += int(n.sum())
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                    out = [pa.array(docs["doc_id"], mask=docs["null"] == 1), pa.array(starts), pa.array(n), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(n, "part").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def default_vocabulary(name: str) -> str:
    """A public vocabulary's path; workers resolve the same path, so it must be installed on each."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, shared.shared_folder(spark), default_vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_token_files(manifest)
