"""Ingestion: list, hash, skip what is done, render, encode, write, record.

Rows are paths and ranges of pages, never contents: whoever hashes, counts or draws a document opens it where it lies.
Rendering is an interface: a renderer counts a document's pages and gives them chunk by chunk; a plain function that gives
all pages of some bytes will do.  The default takes the text of PDF files, and plain text by form feeds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewing.operators.registry import Registry, without_stale
from latewing.session import drop_folder
from latewing.sources.folders import open_file, spread_over
from latewing.sources.pdf import Pdf
from latewing.sources.store import EmbeddingStore, page_chunks

#: Fixed value: the message recorded for a document without pages.
NO_PAGES = "PDF contains zero pages."


class Renderer(Protocol):
    """Gives a document's pages as values that the encoder takes, some pages at a time.  ``file`` is open for reading at any
    place; what is not read stays where it is."""

    def page_count(self, path: str, file: BinaryIO) -> int: ...

    def pages(self, path: str, file: BinaryIO, start: int, end: int, dpi: int) -> list[str]:
        """Pages ``start`` to ``end`` (exclusive), counted from 0."""
        ...


class TextPages:
    """Text, by a function that gives all pages of a document's bytes."""

    def __init__(self, split: Callable[[str, bytes], list[str]] | None = None):
        self.split = split or text_pages

    def page_count(self, path: str, file: BinaryIO) -> int:
        return len(self.split(path, _whole(file)))

    def pages(self, path: str, file: BinaryIO, start: int, end: int, dpi: int) -> list[str]:
        return self.split(path, _whole(file))[start:end]


class DocumentPages(TextPages):
    """The default renderer: pages of PDF files as text; anything else is UTF-8 text, pages parted by form feeds."""

    def page_count(self, path: str, file: BinaryIO) -> int:
        return len(Pdf(file)) if _is_pdf(file) else super().page_count(path, file)

    def pages(self, path: str, file: BinaryIO, start: int, end: int, dpi: int) -> list[str]:
        if not _is_pdf(file):
            return super().pages(path, file, start, end, dpi)
        document = Pdf(file)
        return [document.text(n) for n in range(start, min(end, len(document)))]


def _whole(file: BinaryIO) -> bytes:
    file.seek(0)
    return file.read()


def _is_pdf(file: BinaryIO) -> bool:
    file.seek(0)
    return b"%PDF-" in file.read(1024)


def text_pages(path: str, content: bytes) -> list[str]:
    text = content.decode("utf-8", "replace")
    return text.split("\f") if text else []


def renderer(render: Renderer | Callable[[str, bytes], list[str]] | None) -> Renderer:
    """A renderer as it is, a function of all pages as one, none as the default."""
    if render is None or render is text_pages:
        return DocumentPages()
    return render if hasattr(render, "page_count") else TextPages(render)


def new_documents(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files to ingest: content that is not done yet, once per content, in order of path.

    Failed and pending content is tried again; a second path to known content is skipped and the first path stays.  The
    first path of a content is a partial aggregate; other columns of ``files`` come back by a join on it.
    """
    done = registry.where("status = 'done'").select("file_hash")
    fresh = files.join(done, "file_hash", "left_anti")
    first = fresh.groupBy("file_hash").agg(F.min("file_path").alias("file_path"))
    return fresh.join(first, ["file_hash", "file_path"], "left_semi").dropDuplicates(["file_hash"])


PAGES = "file_hash string, file_path string, page_number int, content string, num_pages int, error_message string"
COUNTED = "file_hash string, file_path string, num_pages int, error_message string"
#: Characters and rows of pages that are sent on together.
DRAWN, DRAWN_ROWS = 1 << 20, 1000
_KINDS = {"string": pa.string(), "int": pa.int32()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[kind]) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def counted(files: DataFrame, render: Renderer) -> DataFrame:
    """(file_hash, file_path, num_pages, error_message) of each file, opened by its path."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    with open_file(path) as file:
                        n = render.page_count(path, file)
                    rows.append((name, path, n, None if n else NO_PAGES))
                except Exception as failure:  # one document must not stop the others
                    rows.append((name, path, 0, str(failure)))
            yield _batch(rows, COUNTED)

    # by path: hashes may be equal or not known
    spread = files.select("file_hash", "file_path").repartition(spread_over(files.sparkSession), "file_path")
    return spread.mapInArrow(count, COUNTED)


def rendered(counts: DataFrame, render: Renderer, dpi: int = 150, chunk: int = 8) -> DataFrame:
    """PAGES of what ``counted`` found: a row per page, or one without a page for a document or a chunk of ``chunk`` pages
    that failed.  A chunk is a path and a range; whoever draws it opens the file."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for name, path, n, failed, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if failed is not None:
                    rows.append((name, path, None, None, n, failed))
                else:
                    try:
                        with open_file(path) as file:
                            pages = render.pages(path, file, start, end, dpi)
                        size += sum(len(page or "") for page in pages)
                        rows += [(name, path, start + k, page, n, None) for k, page in enumerate(pages, 1)]
                    except Exception as failure:
                        rows.append((name, path, None, None, n, str(failure)))
                if size >= DRAWN or len(rows) >= DRAWN_ROWS:
                    yield _batch(rows, PAGES)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, PAGES)

    # documents that failed go along as a row without a range, so that counts are made once
    ranged = counts.withColumn("n_read", F.when(F.col("error_message").isNull(), F.col("num_pages")).otherwise(1))
    chunks = page_chunks(ranged, "n_read", chunk).select("file_hash", "file_path", "num_pages", "error_message", "chunk_start", "chunk_end")
    return chunks.repartition(spread_over(counts.sparkSession), "file_path", "chunk_start").mapInArrow(draw, PAGES)


def _in_order(ops: DataFrame) -> DataFrame:
    """Numbered in order of path: a distributed sort, then rising numbers with gaps between partitions."""
    return ops.orderBy("file_path").withColumn("seq", F.monotonically_increasing_id())


def ingest(
    files: DataFrame, registry: Registry, store: EmbeddingStore, encoder, render: Renderer | Callable[[str, bytes], list[str]] | None = None, dpi: int = 150
) -> dict[str, int]:
    """Ingests new files of ``files`` (file_path, file_hash); returns counts of done and failed documents.

    What is listed, counted and drawn is written once under a new attempt.  Embeddings are written before the registry
    says done and names the attempt.  A crash between leaves ``processing``, which a restart turns to pending and a next
    run takes up again; the pages of the broken attempt are named by nobody.
    """
    spark, made, attempt = files.sparkSession, renderer(render), uuid.uuid4().hex
    work = f"{store.path}-rendered/{attempt}"

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{work}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{work}/{name}")

    fresh = kept(new_documents(files.select("file_hash", "file_path"), registry.table()), "files")
    registry.append(_in_order(fresh.select(F.lit("processing").alias("op"), "file_hash", "file_path")))
    pages = kept(rendered(kept(counted(fresh, made), "counts"), made, dpi), "pages")
    ended = pages.groupBy("file_hash", "file_path").agg(F.max("num_pages").alias("num_pages"), F.min("error_message").alias("error_message"))
    good = pages.join(ended.where("error_message is null").select("file_hash"), "file_hash", "left_semi")
    store.append(encoder.encode_pages(good), attempt)
    ops = ended.select(
        F.when(F.col("error_message").isNull(), "done").otherwise("failed").alias("op"), "file_hash", "file_path", "error_message", "num_pages",
        F.when(F.col("error_message").isNull(), F.lit(f"{store.path}#{attempt}")).alias("embedding_path"),
    )
    registry.append(_in_order(ops))
    counts = dict(ops.groupBy("op").count().collect())
    drop_folder(spark, work)
    return {"done": counts.get("done", 0), "failed": counts.get("failed", 0)}


def sync_deleted(registry: Registry, listing: DataFrame) -> int:
    """Deletes every row whose path is gone; returns how many."""
    table = registry.table()
    stale = table.join(without_stale(table, listing).select("file_hash"), "file_hash", "left_anti")
    return registry.delete(stale).count()


def drop_paths(registry: Registry, gone: DataFrame) -> int:
    """Deletes every row whose path is in ``gone`` (file_path); returns how many."""
    return registry.delete(registry.table().join(gone.select("file_path").distinct(), "file_path", "left_semi")).count()
