"""Watching a folder.

A stream of changes (``sources.folders.FolderChanges``): its offsets are versions of the folder's listing, its rows the files
that came, changed or went between two of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from latewing.sources.folders import PDF, FolderChanges, register


def changed_files(spark: SparkSession, folder: str, state: str, pattern: str = PDF, recursive: bool = False, settle: bool = True) -> DataFrame:
    """A stream of file_path, change (created, modified, deleted), modified, length and version; a file is taken when two
    listings agree on it, without ``settle`` at once.  ``state`` is a folder for this stream's listings."""
    source = register(spark).readStream.format(FolderChanges.name()).option("state", state).option("pattern", pattern)
    return source.option("recursive", str(recursive)).option("settle", str(settle)).load(folder)


def start(changes: DataFrame, checkpoint: str, handle: Callable[[DataFrame, DataFrame], object], every: str | None = None) -> StreamingQuery:
    """Runs ``handle`` on (files that came or changed, files that went) of every micro-batch that has any; ``every`` None
    takes what there is and ends.  A batch that broke off is run again with the same rows."""

    def batch(found: DataFrame, _id: int) -> None:
        come, gone = found.where("change <> 'deleted'"), found.where("change = 'deleted'")
        if not found.isEmpty():
            handle(come, gone)

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """file_path and change (created, modified, deleted) between two listings (file_path, modified)."""
    old = before.select("file_path", F.struct(F.col("modified").alias("was")).alias("old"))
    both = now.select("file_path", F.struct(F.col("modified").alias("is")).alias("new")).join(old, "file_path", "full_outer")
    change = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("new.is") != F.col("old.was"), "modified")
    return both.select("file_path", change.alias("change")).where("change is not null")


def settled(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files whose length is more than zero and the same in two listings: nobody is writing them."""
    return now.where("length > 0").join(before.select("file_path", "length"), ["file_path", "length"], "left_semi")
