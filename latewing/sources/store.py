"""The store of page embeddings: Parquet, one row per page, clustered by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latewing.errors import PageRangeError
from latewing.operators.scoring import packed_bytes
from latewing.schema import PAGE_EMBEDDINGS, STORED_PAGES
from latewing.sources.snapshots import Manifest, Snapshots


class EmbeddingStore:
    """Pages are only ever added, each under the attempt that wrote it.  The registry names one attempt for a document:
    a later one takes the place of an earlier, a deleted document has none.  ``compact`` drops what nobody names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/page_embeddings"
        self.parts = Snapshots(spark, self.path, STORED_PAGES)

    def initialise(self) -> None:
        self.parts.initialise()

    def read(self) -> DataFrame:
        return self.parts.read()

    def append(self, pages: DataFrame, attempt: str | None = None) -> None:
        """Adds pages (``flat`` as bytes or as a list of floats); a document's pages lie together and in order."""
        if pages.schema["flat"].dataType != T.BinaryType():
            pages = packed_bytes(pages)
        pages = pages.select(*PAGE_EMBEDDINGS.fieldNames(), F.lit(attempt).cast("string").alias("attempt"))
        self.parts.append(pages.sortWithinPartitions("file_hash", "page_number"))

    def named(self, registry: DataFrame) -> DataFrame:
        """The pages of the attempts that the registry names."""
        return self.read().join(self._live(registry), ["file_hash", "attempt"], "left_semi")

    @staticmethod
    def _live(registry: DataFrame) -> DataFrame:
        return registry.where("coalesce(embedding_path, '') <> ''").select("file_hash", F.substring_index("embedding_path", "#", -1).alias("attempt"))

    def compact(self, registry: DataFrame) -> None:
        """Puts the named pages alone in the place of what there was; pages added meanwhile stay, and readers go on reading
        what they began.  ``clean`` frees the space."""
        old = self.parts.manifest().parts
        live = self._live(registry)
        rows = self.parts.read(Manifest(parts=old)).join(live, ["file_hash", "attempt"], "left_semi")
        self.parts.replace(old, rows.sortWithinPartitions("file_hash", "page_number"), 1)

    def clean(self, older_than: float = 3600.0) -> int:
        return self.parts.clean(older_than)


def page_chunks(documents: DataFrame, num_pages: str = "num_pages", size: int = 8) -> DataFrame:
    """Half-open page ranges of at most ``size`` pages: chunk_start, chunk_end; none for empty documents."""
    n = F.col(num_pages)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return documents.withColumn("chunk_start", F.explode(starts)).withColumn("chunk_end", F.least(F.col("chunk_start") + size, n))


def page_in_range(page_number: str, num_pages: str):
    """Whether a 1-based page number lies in its document."""
    return (F.col(page_number) >= 1) & (F.col(page_number) <= F.col(num_pages))


def one_page(pages: DataFrame, file_path: str, page_number: int) -> DataFrame:
    """The row of one page of a registered document; out of range is an error."""
    own = pages.where(F.col("file_path") == file_path)
    found = own.where(F.col("page_number") == page_number)
    if page_number < 1 or found.isEmpty():
        raise PageRangeError(f"{file_path} has no page {page_number}")
    return found
