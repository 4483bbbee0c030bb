"""The engine behind one object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewing.config import Config, cache_folder
from latewing.errors import PageRangeError, RegistryError
from latewing.operators import answering, ingestion
from latewing.operators.registry import Registry
from latewing.operators import search as search_operators
from latewing.operators.encoding import encoded, unpacked
from latewing.operators.search import search
from latewing.session import ship
from latewing.sources import files, folders
from latewing.sources.store import EmbeddingStore
from latewing.streaming import watch


class Engine:
    """Registry, embeddings, encoder and folder of one store."""

    def __init__(self, spark: SparkSession, config: Config, encoder, render=None, pattern: str = folders.PDF):
        self.spark, self.config, self.encoder, self.render, self.pattern = ship(spark), config, encoder, render, pattern
        root = config.store or str(cache_folder())
        self.registry, self.store = Registry(spark, root), EmbeddingStore(spark, root)
        self.stream = None

    def start(self) -> dict[str, int]:
        """Creates what is missing, recovers interrupted work, drops what was deleted and ingests what is new."""
        self.registry.initialise()
        self.store.initialise()
        self.registry.reset_in_progress()
        return self.scan()

    def scan(self) -> dict[str, int]:
        found = files.documents(self.spark, self.config.watch_folder, self.pattern)
        ingestion.sync_deleted(self.registry, found.select("file_path"))
        return self._ingest(found)

    def _ingest(self, found: DataFrame) -> dict[str, int]:
        return ingestion.ingest(found, self.registry, self.store, self.encoder, self.render, self.config.render_dpi)

    def watch(self, checkpoint: str, every: str | None = None):
        """Watches the folder, not those below it, as a stream of changes.  With ``every``, new and modified files are ingested
        when nobody writes them any more, and deleted ones dropped; only files that changed are opened.  Without, the
        stream takes what changed since the checkpoint and ends."""

        def change(come: DataFrame, gone: DataFrame) -> None:
            if not gone.isEmpty():
                ingestion.drop_paths(self.registry, gone)
            if not come.isEmpty():
                self._ingest(folders.hashed(come))

        base = checkpoint.rstrip("/")
        stream = watch.changed_files(self.spark, self.config.watch_folder, f"{base}/listings", self.pattern, settle=every is not None)
        self.stream = watch.start(stream, f"{base}/stream", change, every)
        return self.stream

    def stop(self) -> None:
        if self.stream is not None:
            self.stream.stop()
        self.registry.reset_in_progress()

    def query(self, text: str, top_k: int = 5, latest_only: bool = False) -> DataFrame:
        """Hits; an empty text is an error, a blank one has none.  ``latest_only`` leaves out older contents of a path."""
        table = self.registry.table()
        if latest_only:
            newest = table.groupBy("file_path").agg(F.max("ingest_seq").alias("ingest_seq"))
            table = table.join(newest, ["file_path", "ingest_seq"])
        return search(text, self.encoder, table, self.store.read(), top_k, check=True)

    def serve(self, requests: str, answers: str, checkpoint: str, every: str | None = None, most: int = 100):
        """Answers requests as they come: JSON lines (request_id, query, top_k) in files of the folder ``requests``; each
        micro-batch scans the pages once for all of them and writes JSON lines (``search.ANSWERED``) below ``answers``, in a
        folder of its number, so a batch that is run again replaces what it wrote.  ``every`` None answers what is there and ends."""

        def encode(texts: DataFrame) -> DataFrame:
            made = encoded(texts.select(F.col("query_id").alias("file_hash"), F.lit(1).alias("page_number"), F.col("query").alias("content")), self.encoder.model)
            return unpacked(made).select(F.col("file_hash").alias("query_id"), F.col("vectors").alias("query_vectors"))

        def batch(found: DataFrame, number: int) -> None:
            made = search_operators.answered(found, encode, self.registry.table(), self.store.read(), most)
            made.write.mode("overwrite").json(f"{answers.rstrip('/')}/{number}")

        source = self.spark.readStream.schema("request_id string, query string, top_k int").json(requests)
        writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
        self.stream = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
        return self.stream

    def answer(self, text: str, answerer: answering.Answerer | None = None, images: dict | None = None, top_k: int | None = None) -> dict:
        return answering.query_and_answer(text, self.query(text, top_k or self.config.top_k), images or {}, answerer or answering.NoAnswerer())

    def documents(self) -> DataFrame:
        return self.registry.all()

    def status(self) -> DataFrame:
        return self.registry.status()

    def about(self) -> dict[str, str]:
        """What a client asks first."""
        return {"engine": "latewing", "state": "running"}

    def page(self, file_path: str, page_number: int, dpi: int | None = None) -> str | bytes:
        """One page of a registered document as its renderer gives it; nothing else on disk can be read this way.

        A path that is not registered is a RegistryError, a page that the document does not have a PageRangeError.
        """
        row = self.registry.by_path(file_path).first()
        if row is None:
            raise RegistryError(f"{file_path} is not registered")
        render = ingestion.renderer(self.render)
        with folders.open_file(row.file_path) as file:
            if not 1 <= page_number <= render.page_count(row.file_path, file):
                raise PageRangeError(f"{file_path} has no page {page_number}")
            return render.pages(row.file_path, file, page_number - 1, page_number, dpi or self.config.render_dpi)[0]

    def save_page(self, file_path: str, page_number: int, target: str, dpi: int | None = None) -> str:
        """Writes one page to a local file, an image as it is and text as UTF-8; returns the file's name."""
        page = self.page(file_path, page_number, dpi)
        with open(target, "wb") as f:
            f.write(page if isinstance(page, bytes) else page.encode())
        return target

    def compact(self) -> None:
        """Drops pages that no document names; frees what nothing has named for an hour."""
        self.store.compact(self.registry.table())
        self.store.clean()
        self.registry.clean()

    def remove(self, path_or_hash: str) -> bool:
        """Removes one document, by hash or else by path; whether there was one.  Its pages are found no more; ``compact``
        frees their space."""
        gone = self.registry.delete_by_hash(path_or_hash)
        if gone.isEmpty():
            gone = self.registry.delete_by_path(path_or_hash)
        return not gone.isEmpty()
