"""Files written as rows: a name and its bytes.

``FileSink`` is a batch sink of (name, content).  Tasks write below a folder of the attempt; when all have ended the files
move to their places, a task's at a time, and a job that fails leaves nothing.  What tasks tell the driver is their number,
whatever they wrote.  ``npy_files`` makes such rows of a store's pages.
"""

from __future__ import annotations

import io
import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from latewing.sources import folders

FILES = "name string, content binary"


@dataclass
class _Written(WriterCommitMessage):
    task: int


class FileSink(DataSource):
    """``path``: the folder; a name may hold folders.  Mode append keeps files of other names, overwrite drops the folder's."""

    @classmethod
    def name(cls) -> str:
        return "latewing_files"

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"].rstrip("/"), overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.attempt = path, overwrite, f"_attempt-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        system, inside = folders.place(self.path)
        task, made = TaskContext.get().taskAttemptId(), set()
        for batch in iterator:
            for name, content in zip(*batch.columns, strict=True):
                if not name.is_valid:
                    raise ValueError("a file needs a name")
                target = f"{inside}/{self.attempt}/{task}/{name.as_py()}"
                parent = target.rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(target) as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
        return _Written(task)

    def commit(self, messages: list[_Written | None]) -> None:
        system, inside = folders.place(self.path)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
                if info.base_name != self.attempt:
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        with ThreadPoolExecutor(16) as pool:
            for message in messages:
                if message:
                    self._move(system, inside, f"{inside}/{self.attempt}/{message.task}", pool)
        self._clear(system, inside)

    def _move(self, system: fs.FileSystem, inside: str, made: str, pool: ThreadPoolExecutor) -> None:
        """What a task made, folder by folder and some files at a time."""
        waiting = [made]
        while waiting:
            here = waiting.pop()
            target = f"{inside}/{here[len(made) + 1 :]}".rstrip("/")
            found = system.get_file_info(fs.FileSelector(here, allow_not_found=True))
            waiting += [i.path for i in found if i.type == fs.FileType.Directory]
            system.create_dir(target, recursive=True)
            move = lambda names, here=here, target=target: [system.move(f"{here}/{n}", f"{target}/{n}") for n in names]
            list(pool.map(move, batched((i.base_name for i in found if i.type == fs.FileType.File), 1000)))

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*folders.place(self.path))

    def _clear(self, system: fs.FileSystem, inside: str) -> None:
        if system.get_file_info(f"{inside}/{self.attempt}").type == fs.FileType.Directory:
            system.delete_dir(f"{inside}/{self.attempt}")


def save_files(files: DataFrame, folder: str, mode: str = "append") -> None:
    """Writes (name, content) rows as files of a folder that all executors see.  A null content is an empty file, a null
    name an error; of two rows with one name either stays.  Contents made in Python come from ``mapInArrow``: Spark does not
    always plan a Python function of columns below a sink written in Python."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(folders)
    files.sparkSession.dataSource.register(FileSink)
    files.select("name", "content").write.format(FileSink.name()).mode(mode).save(folder)


def npy_files(pages: DataFrame) -> DataFrame:
    """(name, content) of one ``.npy`` file per document, as ``npy_embeddings`` reads them: float32, pages by tokens by
    dimension, pages in order.  The pages of a document must be of one shape."""

    def pack(table: pa.Table) -> pa.Table:
        rows = table.sort_by("page_number")
        shapes = set(zip(rows.column("n_tokens").to_pylist(), rows.column("dim").to_pylist(), strict=True))
        name = rows.column("file_hash")[0].as_py()
        if len(shapes) > 1:
            raise ValueError(f"{name}: pages of {len(shapes)} shapes do not make one array")
        array = np.frombuffer(b"".join(rows.column("flat").to_pylist()), "<f4").reshape(len(rows), *shapes.pop())
        out = io.BytesIO()
        np.save(out, array)
        return pa.table({"name": [f"{name}.npy"], "content": pa.array([out.getvalue()], pa.binary())})

    return pages.select("file_hash", "page_number", "n_tokens", "dim", "flat").groupBy("file_hash").applyInArrow(pack, FILES)
