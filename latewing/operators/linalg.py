"""Matrix products over coordinate tables (i, j, v), by tiles or by cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewing.errors import DimensionError


def transposed(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def gemm_cells(a: DataFrame, b: DataFrame, c: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0, trans_a: bool = False, trans_b: bool = False) -> DataFrame:
    """``gemm`` cell by cell: a join on k, partial sums before the shuffle on the result's cell.  For few or scattered cells.

    ``beta`` 0 ignores what C holds (even if it is no number), ``alpha`` 0 leaves beta * C.
    """
    a = transposed(a) if trans_a else a
    b = transposed(b) if trans_b else b
    left = a.select("i", F.col("j").alias("k"), F.col("v").cast("double").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").cast("double").alias("y"))
    product = left.join(right, "k").groupBy("i", "j").agg((F.lit(float(alpha)) * F.sum(F.col("x") * F.col("y"))).alias("ab"))
    if alpha == 0:
        product = product.withColumn("ab", F.lit(0.0))
    if c is None:
        return product.select("i", "j", F.col("ab").alias("v"))
    old = c.select("i", "j", (F.lit(float(beta)) * F.col("v").cast("double") if beta else F.lit(0.0)).alias("c"))
    both = product.join(old, ["i", "j"], "full_outer")
    return both.select("i", "j", (F.coalesce("ab", F.lit(0.0)) + F.coalesce("c", F.lit(0.0))).alias("v"))


#: Rows and columns of a tile; bytes of tiles that may be sent to every executor.
TILE, SENT_BYTES = 256, 64 << 20

#: A tile ends with its last row and column that hold a cell; what a narrow matrix lacks takes no room.
_TILE = "bi int, bj int, width int, cells binary, held binary"


def _packed(values: np.ndarray, held: np.ndarray) -> tuple[int, bytes, bytes]:
    return values.shape[1], values.tobytes(), np.packbits(held).tobytes()


def _unpacked(width, cells, held) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(cells.as_buffer(), "<f8")
    bits = np.unpackbits(np.frombuffer(held.as_buffer(), np.uint8), count=len(values))
    return values.reshape(-1, width.as_py()), bits.reshape(-1, width.as_py()).astype(bool)


def _tile_batch(tiles: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    packed = list(zip(*(_packed(*t) for t in tiles.values()), strict=True))
    columns = [pa.array([k[i] for k in tiles], pa.int32()) for i in (0, 1)]
    columns += [pa.array(x, kind) for x, kind in zip(packed, (pa.int32(), pa.binary(), pa.binary()), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["bi", "bj", "width", "cells", "held"])


def tiles(m: DataFrame, transpose: bool = False, size: int = TILE) -> DataFrame:
    """(bi, bj, width, cells, held): the cells (i, j, v) in dense tiles of at most ``size`` by ``size``, and which of them there are.  Cells are
    shuffled once, by tile, so a group is bounded; of cells that stand twice the sum counts."""
    row, column = ("j", "i") if transpose else ("i", "j")
    at = m.select(
        F.expr(f"cast({row} div {size} as int)").alias("bi"), F.expr(f"cast({column} div {size} as int)").alias("bj"),
        F.expr(f"cast(({row} % {size}) * {size} + {column} % {size} as int)").alias("at"), F.col("v").cast("double").alias("v"),
    ).groupBy("bi", "bj", "at").agg(F.sum("v").alias("v"))

    def pack(table: pa.Table) -> pa.Table:
        down, across = np.divmod(table.column("at").to_numpy(), size)
        shape = (int(down.max()) + 1, int(across.max()) + 1)
        values, held = np.zeros(shape), np.zeros(shape, bool)
        values[down, across], held[down, across] = table.column("v").to_numpy(), True
        key = (table.column("bi")[0].as_py(), table.column("bj")[0].as_py())
        return pa.Table.from_batches([_tile_batch({key: (values, held)})])

    return at.groupBy("bi", "bj").applyInArrow(pack, _TILE)


def _product(x: np.ndarray, in_x: np.ndarray, y: np.ndarray, in_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The product over the cells that are there, and which cells it has."""
    common = min(x.shape[1], len(y))
    x, in_x, y, in_y = x[:, :common], in_x[:, :common], y[:common], in_y[:common]
    held = (in_x.astype(np.float32) @ in_y.astype(np.float32)) > 0
    if np.isfinite(x).all() and np.isfinite(y).all():
        return x @ y, held
    out = np.zeros(held.shape)
    with np.errstate(invalid="ignore"):
        for k in range(common):  # a cell that is not there is no zero that makes infinity no number
            both = np.outer(in_x[:, k], in_y[k])
            out[both] += np.outer(x[:, k], y[k])[both]
    return out, held


#: Bytes of a result's tiles that a task sums before it passes them on.
_HELD = 4 << 20


def _multiplied(scale: float) -> Callable:
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        size = 0
        for batch in batches:
            for bi, bj, wx, x, in_x, wy, y, in_y in zip(*batch.columns, strict=True):
                made, held = _product(*_unpacked(wx, x, in_x), *_unpacked(wy, y, in_y))
                _add(sums, (bi.as_py(), bj.as_py()), made * scale if scale else np.zeros_like(made), held)
                size += made.nbytes
                if size >= _HELD:
                    yield _tile_batch(sums)
                    sums.clear()
                    size = 0
        if sums:
            yield _tile_batch(sums)

    return multiply


def _add(sums: dict, key: tuple[int, int], values: np.ndarray, held: np.ndarray) -> None:
    old = sums.get(key)
    if old is None:
        sums[key] = (values, held)
        return
    shape = tuple(map(max, old[0].shape, values.shape))
    total, there = np.zeros(shape), np.zeros(shape, bool)
    for v, h in (old, (values, held)):
        total[: v.shape[0], : v.shape[1]] += v
        there[: v.shape[0], : v.shape[1]] |= h
    sums[key] = (total, there)


def _cells(size: int) -> Callable:
    """Cells of the sums of tiles that come in order of their places."""

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (bi, bj), (values, held) in sums.items():
                i, j = np.nonzero(held)
                columns = [pa.array((i + bi * size).astype(np.int32)), pa.array((j + bj * size).astype(np.int32)), pa.array(values[i, j])]
                yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "v"])
            sums.clear()

        for batch in batches:
            for bi, bj, width, cells, held in zip(*batch.columns, strict=True):
                key = (bi.as_py(), bj.as_py())
                if key not in sums:
                    yield from out()
                _add(sums, key, *_unpacked(width, cells, held))
        yield from out()

    return cells_of


def gemm(
    a: DataFrame, b: DataFrame, c: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0, trans_a: bool = False, trans_b: bool = False, tile: int = TILE
) -> DataFrame:
    """alpha * A B + beta * C over the cells (i, j, v) of A B and C, by tiles.

    Every pair of tiles is one matrix product; products are summed per task and then per tile of the result.  Tiles are
    joined on their common index: a side of at most SENT_BYTES, by its measured extent, is sent to all executors; if
    neither is so small, the rows of A are spread over so many tasks that the few values of the common index do not
    matter, and B is repeated for them.

    ``beta`` 0 ignores what C holds (even if it is no number), ``alpha`` 0 leaves beta * C.
    """
    left, right = tiles(a, trans_a, tile), tiles(b, trans_b, tile)
    extent = [x.agg(F.max("i"), F.max("j")).first() for x in (a, b)]
    sizes = [tile * tile * 8 * ((hi[0] or 0) // tile + 1) * ((hi[1] or 0) // tile + 1) for hi in extent]
    left = left.select("bi", F.col("bj").alias("bk"), F.col("width").alias("wx"), F.col("cells").alias("x"), F.col("held").alias("in_x"))
    right = right.select(F.col("bi").alias("bk"), "bj", F.col("width").alias("wy"), F.col("cells").alias("y"), F.col("held").alias("in_y"))
    on = ["bk"]
    if min(sizes) <= SENT_BYTES:
        left, right = (left, F.broadcast(right)) if sizes[1] <= sizes[0] else (F.broadcast(left), right)
    else:
        common = (extent[0][0 if trans_a else 1] or 0) // tile + 1
        spread = max(1, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")) // common)
        left = left.withColumn("part", F.col("bi") % spread)
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        on = ["bk", "part"]
    pairs = left.join(right, on).select("bi", "bj", "wx", "x", "in_x", "wy", "y", "in_y")
    made = pairs.mapInArrow(_multiplied(float(alpha)), _TILE)
    if c is not None:
        made = made.unionByName(tiles(c.withColumn("v", F.col("v").cast("double") * float(beta) if beta else F.lit(0.0)), size=tile))
    return made.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(_cells(tile), "i int, j int, v double")


def projected(vectors: DataFrame, weights: np.ndarray, bias: np.ndarray | None = None, vector: str = "vec", into: str = "projected") -> DataFrame:
    """``vectors`` with weights @ x + bias for each x, in double precision: a matrix product for each Arrow batch.

    Null stays null; a vector of another width than the weights is a DimensionError.
    """
    w = np.asarray(weights, np.float64)
    b = np.zeros(len(w)) if bias is None else np.asarray(bias, np.float64)

    @F.arrow_udf("array<double>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            valid = np.asarray(batch.is_valid())
            if len(set(batch.drop_null().value_lengths().to_pylist()) - {w.shape[1]}):
                raise DimensionError(f"a vector is not {w.shape[1]} wide")
            made = batch.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, w.shape[1]) @ w.T + b
            offsets = np.concatenate([[0], np.cumsum(valid * len(w))]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.ravel()), mask=pa.array(~valid))

    return vectors.withColumn(into, project(F.col(vector)))
