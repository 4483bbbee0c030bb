"""Folders as data sources: listings, content hashes, and a stream of what changed.

Files are never rows with their content.  ``FolderListing`` lists a folder and hashes its files piece by piece, so a file
of any size costs a worker one piece; a folder of many files is listed by the tasks, each taking its share of the names, so
nobody holds them all.  ``hashed`` does the same for given paths alone.  ``FolderChanges`` is a stream whose
offset is the version of a listing and whose rows are the files that two versions tell apart.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from itertools import batched, islice

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PDF = "*.[pP][dD][fF]"

#: Bytes of a file that are read at a time.
PIECE = 1 << 20

#: Files, and bytes of files to be hashed, that one task takes at most; a larger file is a task of its own.
TASK_FILES, TASK_BYTES = 2_000, 256 << 20

#: Files that the driver lists by itself; a folder with more is listed by the tasks, so many unless the option ``tasks`` says
#: otherwise.
LISTED, SHARES = 20_000, 64

_TIME = pa.timestamp("us", tz="UTC")
_ENTRIES = pa.schema([("file_path", pa.string()), ("modified", _TIME), ("length", pa.int64())])


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_file(path: str) -> pa.NativeFile:
    """A file that can be read from any place; nothing is read yet."""
    system, inside = place(path)
    return system.open_input_file(inside)


def content_hash(path: str) -> str:
    """SHA-256 of a file's bytes, in hex."""
    made = hashlib.sha256()
    with open_file(path) as f:
        while piece := f.read(PIECE):
            made.update(piece)
    return made.hexdigest()


def walk(folder: str, pattern: str, recursive: bool, share: tuple[int, int] = (0, 1)) -> Iterator[tuple[str, datetime, int]]:
    """(path, modified, length) of the files below a folder, in any order, of each folder as its names are read.  Empty files,
    and files and folders whose name starts with a dot or an underscore, are not listed; a folder that is not there has no
    files.  ``share`` (k, n) takes the files whose name's hash is k modulo n; of the others nothing but the name is read."""
    system, inside = place(folder)
    local = isinstance(system, fs.LocalFileSystem)
    lead = "" if local else folder[: folder.index(inside)] if inside in folder else ""
    wanted = lambda name: fnmatch.fnmatchcase(name, pattern) and zlib.crc32(os.fsencode(name)) % share[1] == share[0]
    waiting = [inside.rstrip("/") or inside]
    while waiting:
        here = waiting.pop()
        for name, path, is_folder, seen in _names(here) if local else _infos(system, here):
            if name[:1] in "._":
                continue
            if is_folder:
                waiting += [path] * recursive
            elif wanted(name) and (found := seen()) and found[1]:
                yield lead + path, *found


def _names(here: str) -> Iterator[tuple]:
    """name, path, whether it is a folder, and a call for modified and length, of a local folder; names are not gathered."""

    def seen(entry: os.DirEntry) -> tuple[datetime, int] | None:
        try:
            is_file, found = entry.is_file(), entry.stat()
        except FileNotFoundError:
            return None  # it went since
        return (datetime.fromtimestamp(0, UTC) + timedelta(microseconds=found.st_mtime_ns // 1000), found.st_size) if is_file else None

    try:
        with os.scandir(here) as entries_here:
            for entry in entries_here:
                yield entry.name, entry.path, entry.is_dir(), lambda entry=entry: seen(entry)
    except FileNotFoundError:
        return


def _infos(system: fs.FileSystem, here: str) -> Iterator[tuple]:
    """The same of a folder elsewhere, where a folder's files are listed together."""
    for info in system.get_file_info(fs.FileSelector(here, allow_not_found=True)):
        yield info.base_name, info.path, info.type == fs.FileType.Directory, lambda info=info: (info.mtime, info.size) if info.type == fs.FileType.File else None


def _listed(rows: list[tuple[str, datetime, int]]) -> pa.Table:
    return pa.table([[r[i] for r in rows] for i in range(3)], schema=_ENTRIES)


def entries(folder: str, pattern: str, recursive: bool) -> pa.Table:
    """file_path, modified and length of the files that ``walk`` finds, by path."""
    return _listed(sorted(walk(folder, pattern, recursive)))


def _tasks(found: pa.Table, most_bytes: int | None) -> list[pa.Table]:
    """Runs of files of bounded number and, if stated, of bounded length."""
    cuts, size = [0], 0
    for i, length in enumerate(found.column("length").to_pylist()):
        if i > cuts[-1] and (i - cuts[-1] >= TASK_FILES or (most_bytes and size + length > most_bytes)):
            cuts.append(i)
            size = 0
        size += length
    return [found.slice(a, b - a) for a, b in zip(cuts, [*cuts[1:], len(found)], strict=True) if b > a]


@dataclass
class _Files(InputPartition):
    table: pa.Table


@dataclass
class _Share(InputPartition):
    share: tuple[int, int]


def _flag(value: str) -> bool:
    return value.lower() == "true"


class FolderListing(DataSource):
    """``path``, ``pattern`` (of names), ``recursive`` and ``hash``: with hash, files are read, without it file_hash is null.
    ``tasks``: how many tasks share a folder of more than ``LISTED`` files."""

    @classmethod
    def name(cls) -> str:
        return "latewing_folder"

    def schema(self) -> str:
        return "file_path string, modified timestamp, length bigint, file_hash string"

    def reader(self, schema) -> DataSourceReader:
        return _Lister(self.options)


class _Lister(DataSourceReader):
    def __init__(self, options):
        self.folder, self.pattern = options["path"], options.get("pattern", PDF)
        self.recursive, self.hash = _flag(options.get("recursive", "true")), _flag(options.get("hash", "true"))
        self.tasks = int(options.get("tasks", SHARES))

    def partitions(self) -> list[InputPartition]:
        rows = list(islice(walk(self.folder, self.pattern, self.recursive), LISTED + 1))
        if len(rows) > LISTED:
            return [_Share((k, self.tasks)) for k in range(self.tasks)]
        found = _listed(sorted(rows))
        runs = _tasks(found, TASK_BYTES if self.hash else None)
        return [_Files(t.take(pa.array(range(len(t))))) for t in runs] or [_Files(found)]  # a slice would be sent with the whole table

    def read(self, partition: _Files | _Share) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, _Share):
            for rows in batched(walk(self.folder, self.pattern, self.recursive, partition.share), 100):
                yield from self._rows(_listed(rows))
        else:
            yield from self._rows(partition.table)

    def _rows(self, found: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in found.to_batches(max_chunksize=100):
            hashes = [_hash_or_none(p) for p in batch.column(0).to_pylist()] if self.hash else [None] * len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string())], names=[*_ENTRIES.names, "file_hash"])


def _hash_or_none(path: str) -> str | None:
    """Null for a file that went, or cannot be read, since it was listed."""
    try:
        return content_hash(path)
    except OSError:
        return None


class FolderChanges(DataSource):
    """A stream of (file_path, change, modified, length, version); change is created, modified or deleted.

    Options as of ``FolderListing``; ``state`` is a folder that keeps listings by version, for as long as a batch may
    still need them; ``settle`` (true) takes a new or modified file only when two listings in a row agree on it.  A
    renamed file is one that went and one that came.
    """

    @classmethod
    def name(cls) -> str:
        return "latewing_changes"

    def schema(self) -> str:
        return "file_path string, change string, modified timestamp, length bigint, version bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Versions(self.options)


class Versions(DataSourceStreamReader):
    """Version n of a listing is written before an offset names it and dropped when a later one is committed, so a batch is
    planned from the same two listings however often it is run."""

    def __init__(self, options):
        self.folder, self.pattern, self.state = options["path"], options.get("pattern", PDF), options["state"].rstrip("/")
        self.recursive, self.settle = _flag(options.get("recursive", "true")), _flag(options.get("settle", "true"))
        self.seen: dict | None = None

    def _versions(self) -> list[int]:
        system, inside = place(self.state)
        names = (i.base_name for i in system.get_file_info(fs.FileSelector(inside, allow_not_found=True)))
        return sorted(int(n[:-8]) for n in names if n.endswith(".parquet") and n[:-8].isdigit())

    def _kept(self, version: int) -> dict[str, tuple]:
        if not version:
            return {}
        system, inside = place(self.state)
        return _by_path(pq.read_table(f"{inside}/{version}.parquet", filesystem=system))

    def _keep(self, version: int, listing: dict[str, tuple]) -> None:
        """Written under another name first: a version is whole or not there."""
        system, inside = place(self.state)
        system.create_dir(inside, recursive=True)
        rows = [(p, *e) for p, e in sorted(listing.items())]
        pq.write_table(pa.table([[r[i] for r in rows] for i in range(3)], schema=_ENTRIES), f"{inside}/{version}.part", filesystem=system)
        system.move(f"{inside}/{version}.part", f"{inside}/{version}.parquet")

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        last = max(self._versions(), default=0)
        held, now = self._kept(last), _by_path(entries(self.folder, self.pattern, self.recursive))
        before = now if not self.settle else self.seen or {}
        steady = {p: e if before.get(p) == e else held.get(p) for p, e in now.items()}
        steady = {p: e for p, e in steady.items() if e}
        self.seen = now
        if steady != held:
            last += 1
            self._keep(last, steady)
        return {"version": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = self._kept(start["version"]), self._kept(end["version"])
        rows = [(p, "deleted", *old[p]) for p in old.keys() - new.keys()]
        rows += [(p, "modified" if p in old else "created", *e) for p, e in new.items() if old.get(p) != e]
        rows = [(*r, end["version"]) for r in sorted(rows)]
        schema = pa.schema([("file_path", pa.string()), ("change", pa.string()), *list(_ENTRIES)[1:], ("version", pa.int64())])
        return [_Files(pa.table([[r[i] for r in rows[at : at + TASK_FILES]] for i in range(5)], schema=schema)) for at in range(0, max(len(rows), 1), TASK_FILES)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        yield from partition.table.to_batches()

    def commit(self, end: dict) -> None:
        system, inside = place(self.state)
        for version in self._versions():
            if version < end["version"]:
                system.delete_file(f"{inside}/{version}.parquet")


def _by_path(listing: pa.Table) -> dict[str, tuple]:
    paths, modified, lengths = (listing.column(i).to_pylist() for i in range(3))
    return dict(zip(paths, zip(modified, lengths, strict=True), strict=True))


def register(spark: SparkSession) -> SparkSession:
    """Makes both sources known to a session; returns it.

    Spark plans a stream in a process of its own, which has none of the session's shipped files: this module goes there as
    part of the source.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FolderListing)
    spark.dataSource.register(FolderChanges)
    return spark


def hashed(listing: DataFrame, path: str = "file_path", tasks: int | None = None) -> DataFrame:
    """(file_path, file_hash) of the given paths; files that cannot be read are left out. Nothing else is opened."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, _hash_or_none(p)) for p in batch.column(0).to_pylist()]
            kept = [r for r in rows if r[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], pa.string()) for i in range(2)], names=["file_path", "file_hash"])

    spread = listing.select(path).distinct().repartition(tasks or spread_over(listing.sparkSession), path)
    return spread.mapInArrow(read, "file_path string, file_hash string")


def spread_over(spark: SparkSession) -> int:
    """Tasks for rows that are small but stand for much work, which Spark would put together by their bytes."""
    return max(8, 4 * spark.sparkContext.defaultParallelism)
