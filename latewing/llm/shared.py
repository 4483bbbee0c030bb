"""What the operators share: a folder that all executors see, and numpy kernels over Arrow text.

The kernels work on slices of a batch of about ``SLICE_BYTES`` and never on a prefix of a text; a text longer than
that is a slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from latewing.session import shared_root, ship

#: Bytes of text that a kernel works on at a time.
SLICE_BYTES = 500_000

#: The six characters that part words in all contracts.
WORD_GAPS = b" \t\n\x0b\x0c\r"

_IN_WORD = np.ones(256, bool)
_IN_WORD[list(WORD_GAPS)] = False


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the session's JVM ends.

    Where the setting is absent a temporary local folder stands in for it on one machine; on a cluster that is an error.
    """
    path = f"{shared_root(spark)}/latewing-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written once as Parquet in a shared folder and read back: lineage ends here, and lost executors cost a
    reread, not a recomputation."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, *paths: str) -> None:
    """Removes intermediate tables that nothing reads any more."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that clash with none of those taken, in any case."""
    held, out = {t.lower() for t in taken}, []
    for name in wanted:
        while (name := f"_{name}").lower() in held:
            pass
        held.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lean(batches: Iterator, *forget: Callable[[], object]) -> Iterator:
    """Passes ``batches`` on; when they end, gives freed memory back to the machine, so that workers that wait for the next
    stage stay small.  ``forget`` is called before."""
    try:
        yield from batches
    finally:
        for call in forget:
            call()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the int64 offsets of its rows in them; nulls are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of a column, each of one long row or about ``size`` bytes."""
    data, offsets = text_bytes(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of some rows, and for each row the index of its first word (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _IN_WORD[data]
    first = np.zeros(len(data), bool)
    rows = offsets[:-1]
    first[rows[rows < len(data)]] = True  # rows touch each other
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    last = np.zeros(len(data), bool)
    last[:-1] = first[1:]
    last[-1] = True
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | last)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words of each row."""
    counts = [np.diff(word_spans(data, offsets)[2]) for _, _, data, offsets in slices(column)]
    return np.concatenate(counts) if counts else np.zeros(0, np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spread(n: int, salt: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) | np.uint64(1)


_BYTE_CODE = spread(256, 7)
_BASE = 0x9FB21C651E98DF25  # odd, so that it has an inverse
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        steps = np.full(max(n, SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same on every machine. ``lower``: A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    codes = _BYTE_CODE
    if lower:
        codes = codes.copy()
        codes[65:91] = codes[97:123]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * _power("up", _BASE, len(data))[: len(data)], out=sums[1:])
    back = _power("down", pow(_BASE, -1, 1 << 64), len(data))
    return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` word hashes (len(words) - width + 1 values; none if shorter)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, factor in enumerate(spread(width, 100 + width)):
        total += words[j : j + n] * factor
    return mix64(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
