"""Documents from folders, and vectors from .npy files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from latewing.schema import PAGE_EMBEDDINGS
from latewing.sources.folders import PDF, FolderListing, register, spread_over


def documents(spark: SparkSession, folder: str, pattern: str = PDF, recursive: bool = True) -> DataFrame:
    """file_path, modified, length and file_hash of the files below a folder, hashed by pieces; empty files are not listed."""
    source = register(spark).read.format(FolderListing.name()).option("pattern", pattern).option("recursive", str(recursive)).option("tasks", spread_over(spark))
    return source.load(folder).where("file_hash is not null")


def listing(spark: SparkSession, folder: str, pattern: str = PDF, recursive: bool = True) -> DataFrame:
    """The same without reading any content: file_path, modified, length."""
    source = register(spark).read.format(FolderListing.name()).option("pattern", pattern).option("recursive", str(recursive)).option("tasks", spread_over(spark))
    return source.option("hash", "false").load(folder).drop("file_hash")


def npy_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Packed pages of ``<file_hash>.npy`` files: 3-D arrays hold pages, 2-D arrays one page."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                pages = np.load(io.BytesIO(content)).astype(np.float32)
                pages = pages[None] if pages.ndim == 2 else pages
                n, tokens, dim = pages.shape
                stem = path.rsplit("/", 1)[-1].removesuffix(".npy")
                flat = pa.array([page.tobytes() for page in pages], pa.binary())
                out = [pa.array([stem] * n), pa.array(range(1, n + 1), pa.int32()), pa.array([tokens] * n, pa.int32()), pa.array([dim] * n, pa.int32()), flat]
                yield pa.RecordBatch.from_arrays(out, names=PAGE_EMBEDDINGS.fieldNames())

    return files.select("path", "content").mapInArrow(read, PAGE_EMBEDDINGS)
