"""The ingestion registry: an append-only log of operations and the table that follows from it.

An operation on a file (by content hash) may depend on what the file's row was, so a row is the fold of its key's
operations in order of ``seq``:

    op          no row yet                      row exists
    pending     insert as pending               path and time, unless done; the status stays
    processing  insert as processing            path, status, time; error, pages and blob stay
    done        insert                          all replaced, error cleared
    failed      nothing                         path, status, error, time; pages and blob stay
    reset       nothing                         processing becomes pending
    delete      nothing                         the row goes; later ones start anew
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latewing.functions import texts
from latewing.schema import REGISTRY_LOG
from latewing.sources.snapshots import Conflict, Manifest, Part, Snapshots

#: What is stored: an operation and the normal form of its path.
_STORED = T.StructType([*REGISTRY_LOG.fields, T.StructField("normal_path", T.StringType())])

#: The order of one key's operations with the same ``seq``, which only a compacted log has.
_ORDER = "case op when 'done' then 0 when 'pending' then 1 when 'processing' then 2 when 'failed' then 3 when 'reset' then 4 else 5 end"


def registry_of(log: DataFrame) -> DataFrame:
    """The registry that a log leads to, one row per file hash that is present.

    The fold follows from a few of a key's operations, found by aggregates with partial results, so no key's operations
    are gathered, however many: those before its last delete are gone; the first that inserts gives its place; of the
    later ones the last that sets the status, the last reset, the last done or failed, and the last of all that moves
    the path.
    """
    ops = log.withColumn("_at", F.struct("seq", F.expr(_ORDER).alias("place")))
    gone = ops.where("op = 'delete'").groupBy("file_hash").agg(F.max("_at").alias("_gone"))
    ops = ops.join(gone, "file_hash", "left").where(F.col("_gone").isNull() | (F.col("_at") > F.col("_gone")))

    def last(*kinds: str) -> Column:
        fields = F.struct("_at", "op", "file_path", "num_pages", "embedding_path", "error_message", "at")
        return F.max_by(F.when(F.col("op").isin(*kinds), fields), F.when(F.col("op").isin(*kinds), F.col("_at")))

    found = ops.groupBy("file_hash").agg(
        F.min(F.when(F.col("op").isin("pending", "processing", "done"), F.col("_at"))).alias("first"),
        last("processing", "done", "failed").alias("set"), last("reset").alias("reset"), last("pending").alias("pending"),
        last("done").alias("done"), last("done", "failed").alias("ended"),
    ).where("first is not null")
    counts = F.col("set").isNotNull() & (F.col("set._at") >= F.col("first"))  # a failure before the first insertion does nothing
    found = found.withColumn("set", F.when(counts, F.col("set"))).withColumn("ended", F.when(F.col("ended._at") >= F.col("first"), F.col("ended")))
    was_reset = (F.col("set.op") == "processing") & (F.col("reset._at") > F.col("set._at"))
    status = F.when(F.col("set").isNull() | F.coalesce(was_reset, F.lit(False)), F.lit("pending")).otherwise(F.col("set.op"))
    later = F.col("set").isNull() | ((F.col("set.op") != "done") & (F.col("pending._at") > F.col("set._at")))
    moved = F.when(F.coalesce(later, F.lit(False)), F.col("pending")).otherwise(F.col("set"))
    return found.select(
        "file_hash", moved["file_path"].alias("file_path"), status.alias("status"),
        F.when(F.col("ended.op") == "failed", F.col("ended.error_message")).alias("error_message"),
        F.coalesce("done.num_pages", F.lit(0)).alias("num_pages"), F.col("done.embedding_path").alias("embedding_path"),
        moved["at"].alias("processed_at"), F.col("first.seq").alias("ingest_seq"),
    )


def compacted(log: DataFrame) -> DataFrame:
    """A log with the same registry and at most three operations per key."""
    r = registry_of(log)
    none = F.lit(None)

    def entry(op: str, at: Column, pages: bool, error: Column = none) -> DataFrame:
        return r.select(
            at.alias("seq"), F.lit(op).alias("op"), "file_hash", "file_path", (F.col("num_pages") if pages else none).cast("int").alias("num_pages"),
            (F.col("embedding_path") if pages else none).cast("string").alias("embedding_path"), error.cast("string").alias("error_message"),
            F.col("processed_at").alias("at"), F.col("status").alias("_s"), F.col("num_pages").alias("_n"), F.col("embedding_path").alias("_e"),
        )

    held = "_n > 0 or _e is not null"
    first = entry("done", F.col("ingest_seq"), True).where(f"_s = 'done' or {held}")
    bare = entry("pending", F.col("ingest_seq"), False).where(f"_s in ('pending', 'failed') and not ({held})")
    working = entry("processing", F.col("ingest_seq"), False).where(f"_s = 'processing' or (_s = 'pending' and ({held}))")
    again = entry("reset", F.col("ingest_seq"), False).where(f"_s = 'pending' and ({held})")
    failed = entry("failed", F.col("ingest_seq"), False, F.col("error_message")).where("_s = 'failed'")
    return first.unionByName(bare).unionByName(working).unionByName(again).unionByName(failed).drop("_s", "_n", "_e")


def reduced(log: DataFrame) -> DataFrame:
    """The operations of a log, or of a stretch of one, that can still matter: of each key the last delete and, of those after
    it, the first that inserts and the last of each kind.

    They keep their ``seq``.  The fold asks for nothing else, and what was dropped is never asked for when more operations
    follow or come before; so reduced stretches, put together and reduced again, are the reduced whole.
    """
    kept = [f.name for f in REGISTRY_LOG]
    ops = log.withColumn("_at", F.struct("seq", F.expr(_ORDER).alias("place")))
    last_delete = ops.where("op = 'delete'").groupBy("file_hash").agg(F.max("_at").alias("_gone"))
    ops = ops.join(last_delete, "file_hash", "left").where(F.col("_gone").isNull() | (F.col("_at") >= F.col("_gone")))
    row = F.struct(*kept)
    inserts = F.col("op").isin("pending", "processing", "done")
    kinds = ("pending", "processing", "done", "failed", "reset", "delete")
    found = ops.groupBy("file_hash").agg(
        F.min_by(F.when(inserts, row), F.when(inserts, F.col("_at"))).alias("first"),
        *[F.max_by(F.when(F.col("op") == k, row), F.when(F.col("op") == k, F.col("_at"))).alias(k) for k in kinds],
    )
    rows = F.array_distinct(F.array("first", *kinds))
    return found.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("x.*").select(*kept)


def _clustered(ops: DataFrame) -> DataFrame:
    return ops.withColumn("normal_path", texts.normal_path_column(F.col("file_path"))).sortWithinPartitions("file_hash")


def _full(parts: tuple[Part, ...], size: int) -> tuple[Part, ...] | None:
    """The first parts of one level, the lowest that has ``size`` of them together."""
    for level in sorted({p.level for p in parts}):
        at = [i for i, p in enumerate(parts) if p.level == level]
        if len(at) >= size and at[size - 1] - at[0] == size - 1:
            return parts[at[0] : at[0] + size]
    return None


class Registry:
    """The registry of one store, kept as a log below ``path``, in parts under numbered manifests: any number of writers may
    append at once.

    Each append is a part.  ``MERGE`` parts of a level that lie together become one of the next level, reduced, so an
    operation is rewritten once per level, and the log stays within a few operations per key and the parts of the newest
    appends.  Parts are clustered by file hash and have bloom filters of hash and path, so a lookup skips row groups.
    """

    MERGE = 8

    def __init__(self, spark: SparkSession, path: str):
        filters = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("file_hash", "normal_path")}
        sizes = {f"parquet.bloom.filter.expected.ndv#{c}": "100000" for c in ("file_hash", "normal_path")}
        self.spark, self.path = spark, f"{path.rstrip('/')}/registry_log"
        self.parts = Snapshots(spark, self.path, _STORED, **filters, **sizes, **{"parquet.block.size": str(8 << 20)})

    def initialise(self) -> None:
        """Creates the empty log if there is none."""
        self.parts.initialise()

    def _stored(self) -> DataFrame:
        return self.parts.read()

    def log(self) -> DataFrame:
        return self._stored().select(*REGISTRY_LOG.fieldNames())

    def append(self, ops: DataFrame) -> None:
        """Adds operations (op, file_hash and any fields); they follow all before and keep the order of ``seq`` among them."""
        for field in REGISTRY_LOG:
            if field.name not in ops.columns:
                made = F.current_timestamp() if field.name == "at" else F.lit(0 if field.name == "seq" else None)
                ops = ops.withColumn(field.name, made.cast(field.dataType))
        self._merge(self.parts.append(_clustered(ops)))

    def _merge(self, now: Manifest) -> None:
        """Merges full levels, the lowest first.  Another writer that merges the same parts may come first: then it is done."""
        while (run := _full(now.parts, self.MERGE)) is not None:
            rows = reduced(self.parts.read(replace(now, parts=run)).select(*REGISTRY_LOG.fieldNames()))
            try:
                now = self.parts.replace(run, _clustered(rows), run[0].level + 1)
            except Conflict:
                now = self.parts.manifest()

    def table(self) -> DataFrame:
        return registry_of(self.log())

    def all(self) -> DataFrame:
        return self.table().orderBy("ingest_seq")

    def by_hash(self, file_hash: str) -> DataFrame:
        """The filter reaches the log's scan: only this key's operations are folded."""
        return registry_of(self.log().where(F.col("file_hash") == file_hash))

    #: Contents that a path may have had for its lookup to filter by their hashes; beyond, they are joined.
    FEW = 200

    def by_path(self, path: str) -> DataFrame:
        """The first row, by insertion, whose path is the given one or has the same normal form.

        Both filters reach the scan: the path gives the hashes that ever had it, those give their operations.
        """
        normal = texts.normal_path(path)
        had = self._stored().where((F.col("normal_path") == normal) | (F.col("file_path") == path)).select("file_hash").distinct()
        keys = [r.file_hash for r in had.limit(self.FEW + 1).collect()]
        own = self.log().where(F.col("file_hash").isin(keys)) if len(keys) <= self.FEW else self.log().join(had, "file_hash", "left_semi")
        same = (F.col("file_path") == path) | (texts.normal_path_column(F.col("file_path")) == normal)
        return registry_of(own).where(same).orderBy("ingest_seq").limit(1)

    def _record(self, **values) -> None:
        at = values.pop("at", None)
        row = self.spark.createDataFrame([tuple(values.get(f.name) if f.name not in ("seq", "at") else (0 if f.name == "seq" else at) for f in REGISTRY_LOG)], REGISTRY_LOG)
        self.append(row.withColumn("at", F.coalesce("at", F.current_timestamp())))

    def pending(self, file_hash: str, file_path: str) -> None:
        self._record(op="pending", file_hash=file_hash, file_path=file_path)

    def processing(self, file_hash: str, file_path: str) -> None:
        self._record(op="processing", file_hash=file_hash, file_path=file_path)

    def done(self, file_hash: str, file_path: str, num_pages: int, embedding_path: str) -> None:
        self._record(op="done", file_hash=file_hash, file_path=file_path, num_pages=num_pages, embedding_path=embedding_path)

    def failed(self, file_hash: str, file_path: str, error_message: str) -> None:
        self._record(op="failed", file_hash=file_hash, file_path=file_path, error_message=error_message)

    def delete(self, rows: DataFrame) -> DataFrame:
        """Deletes the rows with these hashes; returns what was deleted."""
        before = self.parts.manifest()  # what is returned is read from it, so it does not change with the log
        there = registry_of(self.parts.read(before).select(*REGISTRY_LOG.fieldNames())).join(rows.select("file_hash").distinct(), "file_hash", "left_semi")
        self.append(there.select(F.lit("delete").alias("op"), "file_hash", F.col("ingest_seq").alias("seq")))
        return there

    def clean(self, older_than: float = 3600.0) -> int:
        """Frees parts that were merged away; see ``Snapshots.clean``."""
        return self.parts.clean(older_than)

    def delete_by_hash(self, file_hash: str) -> DataFrame:
        return self.delete(self.by_hash(file_hash))

    def delete_by_path(self, path: str) -> DataFrame:
        """Deletes one row, the first with this path."""
        return self.delete(self.by_path(path))

    def reset_in_progress(self) -> int:
        """Turns every processing row to pending; returns how many."""
        held = self.table().where("status = 'processing'")
        n = held.count()
        if n:
            self.append(held.select(F.lit("reset").alias("op"), "file_hash", F.col("ingest_seq").alias("seq")))
        return n

    def status(self) -> DataFrame:
        return status_counts(self.table())


def status_counts(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count("*").alias("total_documents"), F.count_if(F.col("status") == "done").alias("indexed_documents"))


def reset_in_progress(registry: DataFrame) -> DataFrame:
    return registry.withColumn("status", F.when(F.col("status") == "processing", F.lit("pending")).otherwise(F.col("status")))


def without_stale(registry: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose path is still listed."""
    return registry.join(listing.select("file_path").distinct(), "file_path", "left_semi")
