"""Search: the best pages for a query over everything that is indexed."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latewing.errors import DimensionError, EmptyQueryError
from latewing.functions import texts
from latewing.operators import scoring
from latewing.schema import HITS
from latewing.session import shared_root


def searchable(registry: DataFrame) -> DataFrame:
    """Finished documents with a place of their embeddings."""
    return registry.where("status = 'done' and coalesce(embedding_path, '') <> ''")


def rank_hits(registry: DataFrame, scored: DataFrame, pages: DataFrame, top_k: int, digits: int | None = None) -> DataFrame:
    """Hits from scored pages (file_hash, page_number, score): best first, ties in order of ingestion and page.

    The registry is joined with keys and scores, never with vectors.  The limit above the sort is a bounded heap in every
    task.  How many pages a document has is counted in ``pages`` for the few documents among the hits alone.  Where pages
    have an ``attempt``, only those of the attempt that the registry names count.
    """
    if top_k < 0:
        raise ValueError("top_k cannot be negative")
    keys = ["file_hash", "attempt"] if "attempt" in scored.columns else ["file_hash"]
    score = F.col("score") if digits is None else F.round("score", digits)
    live = searchable(registry).select("file_hash", "file_path", "ingest_seq", F.substring_index("embedding_path", "#", -1).alias("attempt"))
    order = [F.desc("score"), "ingest_seq", "page_number"]
    best = scored.withColumn("score", score.cast("double")).join(live if len(keys) > 1 else live.drop("attempt"), keys)
    best = best.select(*keys, "score", "file_path", F.col("page_number").cast("int").alias("page_number"), "ingest_seq").orderBy(*order).limit(top_k)
    few = F.broadcast(best) if top_k <= SENT_HITS else best
    counted = pages.select(*keys).join(few, keys).groupBy(*best.columns).agg(F.count("*").cast("int").alias("total_pages"))
    return counted.orderBy(*order).select("score", "file_path", texts.basename(F.col("file_path")).alias("filename"), "file_hash", "page_number", "total_pages")


#: Hits that are sent to all executors to count the pages of their documents.
SENT_HITS = 100_000

ENVELOPE = "low binary, high binary"


def enveloped(embeddings: DataFrame, keys: list[str], flat: str = "flat", dim: str = "dim") -> DataFrame:
    """(keys, low, high): the least and the greatest value of each component over a page's vectors, as bytes of 32-bit floats.

    A table of its own, beside the pages: it has two vectors a page however many tokens the page has.  Pages without tokens,
    or with a value that is no number, have none.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in embeddings.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = [], []
            for width, raw in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1), strict=True):
                page = np.frombuffer(raw.as_buffer() if raw.is_valid else b"", "<f4")
                good = width and len(page) and np.isfinite(page).all()
                page = page.reshape(-1, width) if good else None
                lows.append(page.min(0).tobytes() if good else None)
                highs.append(page.max(0).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(lows, pa.binary()), pa.array(highs, pa.binary())], names=[*keys, "low", "high"])

    return embeddings.select(*keys, dim, flat).mapInArrow(run, f"{kinds}, {ENVELOPE}")


def bounded(envelopes: DataFrame, query: np.ndarray, keys: list[str]) -> DataFrame:
    """(keys, bound): no page's score is above its bound.  Of a query vector q and a page's envelope no dot product exceeds
    the sum of the greater of q * low and q * high; pages without an envelope have the bound infinity."""
    matrix = np.ascontiguousarray(query, np.float64)
    up, down = np.maximum(matrix, 0), np.minimum(matrix, 0)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in envelopes.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(len(batch), np.inf)
            low, high = batch.column(len(keys)), batch.column(len(keys) + 1)
            there = np.flatnonzero(np.asarray(low.is_valid()))
            if len(there):
                lows, highs = (np.frombuffer(b"".join(c.take(pa.array(there)).to_pylist()), "<f4").reshape(len(there), -1).astype(float) for c in (low, high))
                if lows.shape[1] != matrix.shape[1]:
                    raise DimensionError(f"a page's vectors are not {matrix.shape[1]} wide")
                bound = highs @ up.T + lows @ down.T
                slack = 1e-5 * (np.abs(highs) @ up.T + np.abs(lows) @ -down.T)  # products of pages are taken in single precision
                out[there] = (bound + slack).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out)], names=[*keys, "bound"])

    return envelopes.select(*keys, "low", "high").mapInArrow(run, f"{kinds}, bound double")


def best_pages(
    pages: DataFrame, envelopes: DataFrame, query: np.ndarray, keys: list[str], top_k: int, order: list[str], first: int = 64, growth: int = 8
) -> tuple[DataFrame, dict[str, int]]:
    """(keys, order, score) of pages among which are all of the best ``top_k``, and how many pages were scored.

    Pages (keys, columns of ``order``, flat) are scored in the order of their bounds, ``first`` times ``top_k`` at the start
    and ``growth`` times as many in each next round, until the ``top_k``-th score so far is above every bound that is
    left; the rest cannot be among the best, ties included.  A round reads its pages by the range of their bounds.
    """
    bounds = bounded(envelopes, query, keys)
    spark = pages.sparkSession
    name = f"{shared_root(spark)}/bounds-{uuid.uuid4().hex}"
    bounds.write.parquet(name)
    bounds = spark.read.schema(bounds.schema).parquet(name)
    total, scored, size, upper, out = bounds.count(), 0, max(1, first * max(top_k, 1)), None, None
    while True:
        left = bounds if upper is None else bounds.where(F.col("bound") < upper)
        cut = left.orderBy(F.desc("bound")).limit(size).agg(F.min("bound")).first()[0]
        if cut is None:
            break
        own = left.where(F.col("bound") >= cut)
        now = scoring.score_packed(pages.join(own.select(*keys), keys, "left_semi"), query, [*keys, *order])
        held = f"{name}-{scored}"
        now.write.parquet(held)
        now = spark.read.schema(now.schema).parquet(held)
        out = now if out is None else out.unionByName(now)
        scored += own.count()
        upper = cut
        kth = out.orderBy(F.desc("score")).limit(top_k).agg(F.min("score"), F.count("*")).first()
        rest = bounds.where(F.col("bound") < upper).agg(F.max("bound")).first()[0]
        if rest is None or (kth[1] >= top_k and (top_k == 0 or kth[0] > rest)):
            break
        size *= growth
    if out is None:
        out = scoring.score_packed(pages.limit(0), query, [*keys, *order])
    return out, {"pages": total, "scored": scored}


def search(query: str, encoder, registry: DataFrame, embeddings: DataFrame, top_k: int = 5, check: bool = False) -> DataFrame:
    """Hits (schema HITS) for a query text over packed ``embeddings``.

    A blank query has no hits; at the interface (``check``) an empty one is an error.  Documents that are not searchable,
    or have no embeddings, are dropped by the join behind the scores.
    """
    spark = embeddings.sparkSession
    if check and query == "":
        raise EmptyQueryError("the query is empty")
    if top_k < 0:
        raise ValueError("top_k cannot be negative")
    if texts.is_blank(query) or top_k == 0:
        return spark.createDataFrame([], HITS)
    vectors = encoder.encode_texts([query])[0]
    keys = [c for c in ("file_hash", "attempt", "page_number") if c in embeddings.columns]
    return rank_hits(registry, scoring.score_packed(embeddings, vectors, keys), embeddings, top_k)


def search_many(queries: DataFrame, registry: DataFrame, embeddings: DataFrame, top_k: int = 5, digits: int | None = None) -> DataFrame:
    """(query_id, rank, columns of HITS) of many queries (query_id, query_vectors) with one scan of the pages.

    Every block of pages is scored for all queries and passes on what can be among a query's best; ranks, ties and page
    counts are those of ``rank_hits``.  A query without vectors scores 0 everywhere; query_id must not repeat.
    """
    if top_k < 0:
        raise ValueError("top_k cannot be negative")
    keys = [c for c in ("file_hash", "attempt", "page_number") if c in embeddings.columns]
    on = [c for c in keys if c != "page_number"]
    live = searchable(registry).select("file_hash", "file_path", "ingest_seq", F.substring_index("embedding_path", "#", -1).alias("attempt"))
    live = live if "attempt" in on else live.drop("attempt")
    named = embeddings.join(live.select(*on), on, "left_semi")  # before scoring: only what counts can be among the best
    scored = scoring.score_matrix_packed(queries, named, keys, top=top_k if digits is None else None)
    score = F.col("score") if digits is None else F.round("score", digits)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ingest_seq", "page_number")
    best = scored.withColumn("score", score.cast("double")).join(live, on).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    best = best.withColumn("page_number", F.col("page_number").cast("int"))
    counted = embeddings.groupBy(*on).agg(F.count("*").cast("int").alias("total_pages"))  # of keys alone, no vector is read
    return best.join(counted, on).select("query_id", "rank", "score", "file_path", texts.basename(F.col("file_path")).alias("filename"), "file_hash", "page_number", "total_pages")


ANSWERED = "request_id string, outcome string, error string, hits array<struct<rank int, score double, file_path string, filename string, file_hash string, page_number int, total_pages int>>"


def answered(requests: DataFrame, encode, registry: DataFrame, embeddings: DataFrame, most: int = 100) -> DataFrame:
    """ANSWERED: an outcome for every request (request_id, query, top_k) of a batch, all of them with one scan of the pages.

    ``encode`` makes (query_id, query_vectors) of (query_id, query).  An empty or null query, and a ``top_k`` below 0 or
    above ``most``, is the outcome ``error`` and says why; a blank query or a top_k of 0 is ``no_results``; else
    ``success``, or ``no_results`` where nothing is indexed.  A null top_k is 5.  Of requests with one id each has its answer.
    """
    k = F.coalesce("top_k", F.lit(5))
    error = (
        F.when(F.coalesce(F.col("query"), F.lit("")) == "", "the query is empty")
        .when((k < 0) | (k > most), F.concat(F.lit(f"top_k must lie between 0 and {most}, not "), k.cast("string")))
    )
    asked = requests.select("request_id", "query", k.alias("top_k"), error.alias("error"))
    real = asked.where(F.col("error").isNull() & (F.length(texts.strip(F.col("query"))) > 0) & (F.col("top_k") > 0))
    queries = encode(real.select(F.col("query").alias("query_id"), "query").distinct())  # a text is its own key: asked twice, scored once
    hits = search_many(queries, registry, embeddings, most)
    rows = F.struct("rank", "score", "file_path", "filename", "file_hash", "page_number", "total_pages")
    hits = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(rows)).alias("found"))  # at most ``most`` each
    both = asked.join(hits, (asked["query"] == hits["query_id"]) & asked["error"].isNull(), "left")
    mine = F.when(F.col("top_k") > 0, F.slice(F.coalesce("found", F.array()), F.lit(1), F.greatest("top_k", F.lit(1)))).otherwise(F.array())
    mine = F.when(F.col("error").isNull(), mine).otherwise(F.array())
    outcome = F.when(F.col("error").isNotNull(), "error").when(F.size(mine) == 0, "no_results").otherwise("success")
    return both.select("request_id", outcome.alias("outcome"), "error", mine.alias("hits"))
