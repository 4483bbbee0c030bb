"""Exact top-k by inner product with a table of distances to pivots.

Vectors are put on a sphere: with one more component sqrt(R^2 - |x|^2), R the greatest norm, a query's greatest inner
products belong to its nearest points.  The pivot table holds each point's distances to many pivots, drawn far apart.  By
the triangle inequality |d(q, p) - d(x, p)| is at most d(q, x) for every pivot p; the greatest of these is x's lower
bound.  A query takes points in the order of their bounds, in runs of growing length, and stops when the next bound lies beyond
the k-th distance found: nothing behind it can be nearer.

Points nearest to the same one of a few pivots lie in one block, cut by hash where they are many; a block knows the least and the
greatest distance to each pivot, which bound all its points at once.  Queries are dealt into blocks in the same way.
First every block of queries meets a block of its own pivot, which gives each query a k-th distance.  Then blocks of
queries and the intervals of blocks of points (no vectors) meet, and only pairs of blocks that the intervals leave are
sent: to some tasks for each block of queries, nearest blocks first, so that k-th distances shrink on the way.  The best
k of each task are merged per query.  Blocks have a bounded number of rows, so memory does not grow.  A stopping rule
carries no error: distances and bounds are compared with a margin above their rounding.

How much the bounds save depends on the vectors; the README has figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latewing.llm import shared

#: Whole numbers below this are exact in double arithmetic.
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """(vec_id, x array<bigint>): floor(scale * component).  Vectors that are null or hold a null, NaN or infinite
    component, and those without an id, are left out."""
    x = F.transform(F.col(embedding), lambda c: F.floor(F.lit(scale) * c.cast("double")))
    usable = F.col(embedding).isNotNull() & F.forall(
        F.col(embedding), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf")))
    )
    return vectors.where(usable & F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores and their ids, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        scores, ids = scores[near], ids[near]
    keep = np.lexsort((ids, -scores))[:k]
    return ids[keep], scores[keep]


def _margin(radius2: float) -> float:
    """Above the rounding of distances and of bounds in 32 bits."""
    return 1e-4 * (1.0 + np.sqrt(radius2))


class Search:
    """A block of queries on its way through blocks of points: the best k so far of each.

    ``known`` are scores that k other points of the table are known to reach at least (or None).
    """

    def __init__(self, queries: np.ndarray, ids: np.ndarray, radius2: float, pivots: np.ndarray, k: int, known: np.ndarray | None = None, run: int = 256):
        self.queries, self.ids, self.radius2, self.k, self.run = queries, ids, radius2, k, run
        self.table = _distances(np.column_stack([queries, np.zeros(len(queries))]), pivots).astype(np.float32)
        self.norms = (queries**2).sum(1)
        self.known = known if known is not None else np.full(len(queries), np.nan)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.evaluated = np.zeros(len(ids), np.int64)

    def limits(self) -> np.ndarray:
        """The distance that a point must not exceed to be among the best k: that of the k-th score known."""
        own = np.array([best[-1] if len(best) == self.k else -np.inf for _, best in self.best])
        score = np.fmax(own, self.known)
        with np.errstate(invalid="ignore"):
            far = np.sqrt(np.maximum(self.radius2 + self.norms - 2.0 * score, 0.0)) + _margin(self.radius2)
        return np.where(np.isfinite(score), far, np.inf)

    def meet(self, points: np.ndarray, ids: np.ndarray, table: np.ndarray) -> None:
        """``table`` holds the points' distances to the pivots, a row for each pivot."""
        exact = max(np.abs(points).max(initial=0.0), 1.0) * max(np.abs(self.queries).max(initial=0.0), 1.0) * points.shape[1] < EXACT
        limits = self.limits()
        step = max(1, (1 << 20) // max(1, len(points)))
        for q in range(len(self.ids)):
            if q % step == 0:  # bounds of the next few queries
                chunk = self.table[q : q + step]
                bounds = np.zeros((len(chunk), len(points)), np.float32)
                gap = np.empty_like(bounds)
                for p in range(len(table)):
                    np.subtract(table[p][None, :], chunk[:, p : p + 1], out=gap)
                    np.abs(gap, out=gap)
                    np.maximum(bounds, gap, out=bounds)
            bound = bounds[q % step]
            rest = np.flatnonzero((bound <= limits[q]) & (ids != self.ids[q]))
            rest = rest[np.argsort(bound[rest], kind="stable")]
            best_ids, best = self.best[q]
            at, size = 0, self.run
            while at < len(rest):
                part = rest[at : at + size]
                if at and len(best) == self.k and bound[part[0]] > np.sqrt(max(self.radius2 + self.norms[q] - 2.0 * best[-1], 0.0)) + _margin(self.radius2):
                    break
                if exact:
                    scores = np.rint(points[part] @ self.queries[q]).astype(np.int64)
                else:
                    scores = points[part].astype(np.int64) @ self.queries[q].astype(np.int64)
                self.evaluated[q] += len(part)
                best_ids, best = _best(np.concatenate([best, scores]), np.concatenate([best_ids, ids[part]]), self.k)
                at, size = at + size, size * 2
            self.best[q] = (best_ids, best)


def search_block(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, radius2: float, pivots: np.ndarray, k: int, run: int = 256):
    """Best k of ``points`` for each query: (query index, ids, scores, points evaluated), ties to the smaller id.
    ``pivots`` are rows of the lifted space."""
    search = Search(queries, query_ids, radius2, pivots, k, run=run)
    search.meet(points, ids, pivot_table(points, radius2, pivots))
    for q, (found, scores) in enumerate(search.best):
        yield q, found, scores, int(search.evaluated[q])


def pivot_table(points: np.ndarray, radius2: float, pivots: np.ndarray) -> np.ndarray:
    """A row for each pivot: its distance to every point on the sphere."""
    lift = np.sqrt(np.maximum(radius2 - (points**2).sum(1), 0.0))
    return _distances(np.column_stack([points, lift]), pivots).astype(np.float32).T.copy()


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.column_stack([np.sqrt(np.maximum(((a - p) ** 2).sum(1), 0.0)) for p in b]) if len(b) else np.zeros((len(a), 0))


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of ``points``, each the farthest from those before it; equal rows once."""
    chosen, gap = [], np.full(len(points), np.inf)
    at = 0
    while len(chosen) < min(n, len(points)):
        chosen.append(at)
        gap = np.minimum(gap, ((points - points[at]) ** 2).sum(1))
        at = int(gap.argmax())
        if gap[at] <= 0:
            break
    return points[chosen]


_BLOCK = "cell int, part bigint, ids binary, kind string, x binary, dist binary, low binary, high binary"


def _blocks(vectors: DataFrame, rows: int, width: int, radius2: float, pivots: np.ndarray, cells: int, lifted: bool, folder: str, name: str) -> DataFrame:
    """Blocks of (vec_id, x) by the nearest of the first ``cells`` pivots, each of about ``rows`` vectors: the ids (int64), the vectors, the
    table of their distances to the pivots (float32, a row for each pivot) and its least and greatest of each row."""
    given = "vec_id bigint, cell int"

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            lift = np.sqrt(np.maximum(radius2 - (x**2).sum(1), 0.0)) if lifted else np.zeros(len(x))
            near = _distances(np.column_stack([x, lift]), pivots[:cells]).argmin(1) if len(pivots) else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near.astype(np.int32)), batch.column("x")], names=["vec_id", "cell", "x"])

    def packed(table: pa.Table) -> pa.Table:
        ids, x = table.column("vec_id").to_numpy(), _matrix(table.column("x").combine_chunks(), width)
        dist = pivot_table(x, radius2, pivots) if lifted else _distances(np.column_stack([x, np.zeros(len(x))]), pivots).astype(np.float32).T
        row = [table.column("cell")[0].as_py(), table.column("part")[0].as_py(), ids.tobytes(), *_packed(x), dist.tobytes(), dist.min(1).tobytes(), dist.max(1).tobytes()]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.string(), *[pa.binary()] * 4]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split(" ")[0] for c in _BLOCK.split(", ")])

    placed = shared.stored(vectors.select("vec_id", "x").mapInArrow(nearest, f"{given}, x array<bigint>"), folder, f"{name}-cells")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / rows).alias("parts"))  # a row for each pivot
    dealt = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts")
    return shared.stored(dealt.groupBy("cell", "part").applyInArrow(packed, _BLOCK), folder, f"{name}-blocks")


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the narrowest type that holds them."""
    most = np.abs(x).max(initial=0.0)
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
    return kind, x.astype(kind).tobytes()


def _unpacked(kind: str, raw: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(rows, width).astype(np.float64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def exact_top_k(
    queries: DataFrame, points: DataFrame, folder: str, k: int = 20, pivots: int = 64, sample: int = 2_048, point_rows: int = 8_192, query_rows: int = 1_024, lanes: int = 8, measured: bool = False
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` greatest inner products of every query of (vec_id, x) with every
    point of (vec_id, x) but its own; all of them if fewer.  Ties go to the smaller vec_id.  ``measured`` adds n_evaluated,
    the number of points that were evaluated for the query.

    Vectors of different widths are filled with zeros.  Repeated rows count as often as they stand there; equal rows of
    one id leave each other out.  Null ids must be left out before (``quantised`` does).  Empty tables, or a query alone,
    give no rows.  ``pivots`` are chosen far apart from ``sample`` points drawn by hash: a bounded sample that only steers
    speed.  Sums must stay below 2^63.
    """
    points = shared.stored(points.select("vec_id", "x"), folder, "points")
    queries = shared.stored(queries.select("vec_id", "x"), folder, "queries")
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    n, radius2, width = points.agg(F.count("*"), F.max(square), F.max(F.size("x"))).first()
    cells = -(-n // point_rows)
    radius2, width = radius2 or 0.0, max(width or 0, queries.agg(F.max(F.size("x"))).first()[0] or 0)
    drawn = points.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample).select("x").toArrow().column("x").combine_chunks()
    x = _matrix(drawn, width)
    base = far_apart(np.column_stack([x, np.sqrt(np.maximum(radius2 - (x**2).sum(1), 0.0))]), pivots)
    point_blocks = _blocks(points, point_rows, width, radius2, base, cells, True, folder, "point")
    query_blocks = _blocks(queries, query_rows, width, radius2, base, cells, False, folder, "query").select(
        F.col("cell").alias("query_cell"), F.col("part").alias("query_part"), F.col("ids").alias("query_ids"), F.col("kind").alias("query_kind"), F.col("x").alias("query_x")
    )

    def opened(row: dict, known: bytes | None = None) -> Search:
        ids = np.frombuffer(row["query_ids"], np.int64)
        return Search(_unpacked(row["query_kind"], row["query_x"], len(ids), width), ids, radius2, base, k, None if known is None else np.frombuffer(known))

    def meet(search: Search, row: dict) -> None:
        ids = np.frombuffer(row["ids"], np.int64)
        search.meet(_unpacked(row["kind"], row["x"], len(ids), width), ids, np.frombuffer(row["dist"], np.float32).reshape(len(base), len(ids)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                search = opened(row)
                if row["ids"] is not None:
                    meet(search, row)
                known = np.array([best[-1] if len(best) == k else np.nan for _, best in search.best])
                yield pa.RecordBatch.from_arrays([pa.array([row["query_cell"]], pa.int32()), pa.array([row["query_part"]], pa.int64()), pa.array([known.tobytes()], pa.binary())], names=["query_cell", "query_part", "known"])

    own = point_blocks.where("part = 0").select(F.col("cell").alias("query_cell"), "ids", "kind", "x", "dist")
    known = shared.stored(query_blocks.join(own, "query_cell", "left").mapInArrow(first, "query_cell int, query_part bigint, known binary"), folder, "known")
    asked = shared.stored(query_blocks.join(known, ["query_cell", "query_part"]), folder, "asked")

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, last = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["query_cell"], row["query_part"]) != last:
                    last, search = (row["query_cell"], row["query_part"]), opened(row, row["known"])
                low, high = np.frombuffer(row["low"], np.float32), np.frombuffer(row["high"], np.float32)
                bound = np.maximum(np.maximum(search.table - high, low - search.table).max(1, initial=0.0), 0.0)
                if (bound <= search.limits()).any():
                    names = ["query_cell", "query_part", "cell", "part", "bound"]
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([row[n] for n in names[:4]] + [float(bound.min())], kinds, strict=True)], names=names)

    # a stated query set against the intervals of all blocks
    tried = asked.join(point_blocks.select("cell", "part", "low", "high"), F.lit(True))
    tried = shared.stored(tried.mapInArrow(left, "query_cell int, query_part bigint, cell int, part bigint, bound double"), folder, "tried")
    meetings = tried.join(point_blocks.select("cell", "part", "ids", "kind", "x", "dist"), ["cell", "part"]).withColumn("lane", F.pmod(F.xxhash64("cell", "part"), F.lit(lanes)))
    meetings = meetings.join(asked, ["query_cell", "query_part"]).repartition("query_cell", "query_part", "lane").sortWithinPartitions("query_cell", "query_part", "lane", "bound")

    def found(search: Search) -> Iterator[pa.RecordBatch]:
        counts = [len(ids) for ids, _ in search.best]
        if sum(counts):
            evaluated = np.repeat(search.evaluated, counts)
            starts = np.cumsum(counts) - counts
            evaluated[np.setdiff1d(np.arange(len(evaluated)), starts)] = 0  # once for each query
            out = [np.repeat(search.ids, counts), *(np.concatenate([b[i] for b in search.best]) for i in (0, 1)), evaluated]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["query_id", "vec_id", "score", "n_evaluated"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, last = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (key := (row["query_cell"], row["query_part"], row["lane"])) != last:
                    if search is not None:
                        yield from found(search)
                    last, search = key, opened(row, row["known"])
                meet(search, row)
        if search is not None:
            yield from found(search)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = meetings.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, n_evaluated bigint")
    ranked = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if measured:
        each = shared.stored(each, folder, "each")
        ranked = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        sums = each.groupBy("query_id").agg(F.sum("n_evaluated").alias("n_evaluated"))
        return ranked.drop("n_evaluated").join(sums, "query_id").select("query_id", "rank", "vec_id", "score", "n_evaluated")
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(shared.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64.0)
    return exact_top_k(vectors.where("vec_id % 20 = 0"), vectors, shared.shared_folder(spark))


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda c: cast(floor(64 * c::double) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), scored as (
  select q.vec_id as query_id, v.vec_id, cast(list_dot_product(q.x::double[], v.x::double[]) as bigint) as score
  from v q join v on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from scored qualify rank <= 20
"""
