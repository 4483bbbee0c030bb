"""Late-interaction scoring of pages.

Two forms of one score.  The plan form is an expression over a page's vectors, without shuffle and without Python.  The
kernel form reads packed pages (one flat buffer a row) batch by batch and multiplies matrices; it is the one for volume.
Both are exact and exhaustive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latewing.errors import DimensionError
from latewing.functions import vectors as V

#: Bytes of packed queries that may be sent to every executor.
QUERY_BYTES = 64 << 20


def pack_pages(tokens: DataFrame, keys: Sequence[str], vector: str = "vec", order: str | None = None) -> DataFrame:
    """One row per page from one row per token: the keys and ``vectors``; token order kept if ``order`` is given."""
    if order is None:
        return tokens.groupBy(*keys).agg(F.collect_list(vector).alias("vectors"))
    ordered = F.array_sort(F.collect_list(F.struct(order, vector)))
    return tokens.groupBy(*keys).agg(F.transform(ordered, lambda t: t[vector]).alias("vectors"))


def score_pages(pages: DataFrame, query: Sequence[Sequence[float]] | Column, vectors: str = "vectors", into: str = "score") -> DataFrame:
    """``pages`` with the score of each row's vectors for one query."""
    made = query if isinstance(query, Column) else V.literal_vectors(query)
    return pages.withColumn(into, V.maxsim(made, F.col(vectors)))


def score_tokens(tokens: DataFrame, query: Sequence[Sequence[float]], keys: Sequence[str], vector: str = "vec") -> DataFrame:
    """(keys, score) from one row per token: maxima are taken as partial aggregates, so a page of any size is never in
    one row.  Cases as in ``vectors.maxsim``."""
    if not len(query):
        return tokens.select(*keys).distinct().withColumn("score", F.lit(0.0))
    own = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key")  # names of keys meet no other names
    sims = tokens.select(own, F.transform(V.literal_vectors(query), lambda q: V.dot(q, F.col(vector))).alias("sims"))
    best = [F.coalesce(F.max(F.when(~F.isnan(F.col("sims")[i]), F.col("sims")[i])), F.lit(V.NEVER)).alias(f"m{i}") for i in range(len(query))]
    total = sum((F.col(f"m{i}") for i in range(1, len(query))), F.col("m0"))
    return sims.groupBy("key").agg(*best).select(*[F.col(f"key.k{i}").alias(k) for i, k in enumerate(keys)], total.alias("score"))


def _block_maxima(flat: np.ndarray, offsets: np.ndarray, query: np.ndarray) -> np.ndarray:
    """For each of some ragged pages, end to end in one buffer of floats, the best similarity with each query vector; zeros
    for empty pages."""
    q_len, dim = query.shape
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), q_len), np.float64)
    if not q_len or not dim or not flat.size:
        return out
    if (lengths % dim).any():
        raise DimensionError(f"a page's buffer is no multiple of the query's width {dim}")
    full = np.flatnonzero(lengths)
    with np.errstate(invalid="ignore"):
        sims = flat.reshape(-1, dim) @ query.T
    starts = offsets[:-1][full] // dim
    best = np.maximum.reduceat(sims, starts, axis=0)
    if np.isnan(best).any():  # a maximum over a similarity that is no number is none either: only then look at all
        sims[np.isnan(sims)] = -np.inf
        best = np.maximum.reduceat(sims, starts, axis=0)
    out[full] = best
    return out


def _block_scores(flat: np.ndarray, offsets: np.ndarray, query: np.ndarray) -> np.ndarray:
    return _block_maxima(flat, offsets, query).sum(1)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The floats of an Arrow column of lists or of bytes, and the bounds of its rows in them; nulls are empty."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        if (offsets % 4 != offsets[0] % 4).any():
            raise DimensionError("a page's buffer is no run of 32-bit floats")
        return np.frombuffer(raw.tobytes() if offsets[0] % 4 else raw, np.float32), (offsets - offsets[0]) // 4
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def packed_bytes(pages: DataFrame, flat: str = "flat") -> DataFrame:
    """``pages`` with the list of floats in ``flat`` as bytes."""
    names = pages.columns
    at = names.index(flat)
    fields = ", ".join(f"`{f.name}` {'binary' if f.name == flat else f.dataType.simpleString()}" for f in pages.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _buffer(batch.column(at))
            raw = np.ascontiguousarray(values, np.float32).tobytes()
            rows = [raw[a * 4 : b * 4] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [pa.array(rows, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return pages.mapInArrow(run, fields)


def score_packed(pages: DataFrame, query: np.ndarray | Sequence[Sequence[float]], keys: Sequence[str], flat: str = "flat", rows: int = 2048) -> DataFrame:
    """(keys, score) of packed pages by the Arrow kernel. ``flat`` is a list of floats or, faster, their bytes; its Arrow
    offsets are the ragged bounds, no row becomes a Python object."""
    matrix = np.ascontiguousarray(query, np.float32)
    if matrix.ndim != 2:
        raise DimensionError("a query is a list of vectors")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                scores = _block_scores(*_buffer(batch.column(len(keys))), matrix)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(scores)], names=[*keys, "score"])

    empty = F.lit(b"") if pages.schema[flat].dataType == T.BinaryType() else F.array().cast("array<float>")
    return pages.select(*keys, F.coalesce(F.col(flat), empty).alias(flat)).mapInArrow(run, f"{fields}, score double")


def split_ragged(batch: DataFrame, dim: int, flat: str = "flat", lengths: str = "doc_lengths") -> DataFrame:
    """Documents of a ragged batch (one flat buffer, one list of token counts): doc_idx and vectors, in order.

    Offsets are running sums of the lengths; what the buffer holds beyond them is ignored.
    """
    keys = [c for c in batch.columns if c not in (flat, lengths)]
    start = F.aggregate(F.slice(F.col(lengths), F.lit(1), F.col("doc_idx")), F.lit(0), lambda s, n: s + n)
    return (
        batch.select("*", F.posexplode(lengths).alias("doc_idx", "doc_len"))
        .withColumn("part", F.slice(F.col(flat), start * dim + 1, F.col("doc_len") * dim))
        .select(*keys, "doc_idx", "doc_len", V.unflatten(F.col("part"), dim).alias("vectors"))
    )


def ragged_offsets(lengths: DataFrame, order: str, length: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each document's first token in the flat buffer of its batch."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lengths.withColumn("first_token", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))


def split_tiles(batch: DataFrame, dim: int, tokens: int, flat: str = "flat") -> DataFrame:
    """Uniform tiles of a flat buffer: tile and vectors; a remainder that fills no tile is dropped."""
    keys = [c for c in batch.columns if c != flat]
    width = dim * tokens
    n = F.floor(F.size(flat) / width).cast("int")
    tiles = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cut = F.slice(F.col(flat), F.col("tile") * width + 1, F.lit(width))
    return batch.withColumn("tile", F.explode(tiles)).select(*keys, "tile", V.unflatten(cut, dim).alias("vectors"))


def score_matrix(queries: DataFrame, pages: DataFrame, query_vectors: str = "query_vectors", vectors: str = "vectors") -> DataFrame:
    """Scores of every query with every page (the product asks for all of them).

    The packed queries are measured; up to QUERY_BYTES they are sent to every executor and the pages stay where they
    are.  More are taken in parts of that size, one after another.
    """
    size = F.coalesce(F.sum(F.aggregate(F.col(query_vectors), F.lit(0), lambda s, v: s + F.size(v))), F.lit(0))
    total = queries.agg(size).first()[0] * 8
    parts = max(1, -(-total // QUERY_BYTES))
    out = None
    for i in range(parts):
        part = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(F.to_json(F.struct(*queries.columns))), F.lit(parts)) == i)
        both = pages.join(F.broadcast(part), how="cross")
        made = both.withColumn("score", V.maxsim(F.col(query_vectors), F.col(vectors))).drop(query_vectors, vectors)
        out = made if out is None else out.unionByName(made)
    return out


def score_matrix_packed(queries: DataFrame, pages: DataFrame, keys: Sequence[str], query_key: str = "query_id", flat: str = "flat", rows: int = 512, top: int | None = None) -> DataFrame:
    """(query_key, keys, score) of every query with every page, by tiles: a block of pages times all vectors of a part of
    the queries is one matrix product.  With ``top``, of each block and query only the pages whose score is not below the
    ``top`` best of the block: all that can be among the ``top`` best of all, ties included.

    ``queries`` has a row per query, ``query_key`` and ``query_vectors``; their size is measured, and parts of at most
    QUERY_BYTES, by hash of the key, go to the executors one after another.  Pages are packed (``flat``) and stay where
    they are.  Cases as in ``score_packed``.
    """
    size = F.coalesce(F.sum(F.aggregate(F.col("query_vectors"), F.lit(0), lambda s, v: s + F.size(v))), F.lit(0))
    parts = max(1, -(-queries.agg(size).first()[0] * 4 // QUERY_BYTES))
    kinds = {f.name: f.dataType.simpleString() for f in [*pages.select(*keys).schema, *queries.select(query_key).schema]}
    fields = ", ".join(f"`{n}` {kinds[n]}" for n in [query_key, *keys])
    empty = F.lit(b"") if pages.schema[flat].dataType == T.BinaryType() else F.array().cast("array<float>")
    packed = pages.select(*keys, F.coalesce(F.col(flat), empty).alias(flat))
    out = None
    for part in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(query_key), F.lit(parts)) == part)
        made = packed.mapInArrow(_against_all(own.select(query_key, "query_vectors").toArrow(), len(keys), rows, top), f"{fields}, score double")
        out = made if out is None else out.unionByName(made)
    return out


def _against_all(queries: pa.Table, n_keys: int, rows: int, top: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores of pages, ``rows`` at a time, with all of some queries."""
    ids = queries.column(0).combine_chunks()
    vectors = [q.as_py() or [] for q in queries.column(1)]
    dim = next((len(v) for q in vectors for v in q), 0)
    if any(len(v) != dim for q in vectors for v in q):
        raise DimensionError("vectors differ in width")
    bounds = np.concatenate([[0], np.cumsum([len(q) for q in vectors])]).astype(np.int64)
    matrix = np.array([v for q in vectors for v in q], np.float32).reshape(int(bounds[-1]), dim)
    full = np.flatnonzero(np.diff(bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                best = _block_maxima(*_buffer(batch.column(n_keys)), matrix)
                scores = np.zeros((len(batch), len(vectors)))
                if len(full) and best.shape[1]:
                    scores[:, full] = np.add.reduceat(best, bounds[:-1][full], axis=1)
                keep = np.ones(scores.shape, bool)
                if top is not None and top < len(batch):
                    keep = scores >= np.partition(scores, len(batch) - top, axis=0)[len(batch) - top] if top else ~keep
                page, asked = np.nonzero(keep)
                columns = [c.take(pa.array(page)) for c in batch.columns[:n_keys]]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(asked)), *columns, pa.array(scores[keep])], names=[queries.column_names[0], *batch.schema.names[:n_keys], "score"])

    return run


def similarity_matrix(pages: DataFrame, query: Sequence[Sequence[float]], keys: Sequence[str], vectors: str = "vectors") -> DataFrame:
    """(keys, q_idx, d_idx, sim): every dot product, unfused."""
    sims = F.transform(V.literal_vectors(query), lambda q: F.transform(F.col(vectors), lambda d: V.dot(q, d)))
    rows = pages.select(*keys, F.posexplode(sims).alias("q_idx", "row"))
    return rows.select(*keys, "q_idx", F.posexplode("row").alias("d_idx", "sim"))


def score_unfused(similarities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores from a similarity matrix: the best of each query vector, then their sum."""
    best = similarities.groupBy(*keys, "q_idx").agg(F.coalesce(F.max(F.when(~F.isnan("sim"), F.col("sim"))), F.lit(V.NEVER)).alias("best"))
    return best.groupBy(*keys).agg(F.sum("best").alias("score"))
