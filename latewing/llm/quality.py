"""Quality rules by compression bands, over whole texts.

A text that says little compresses well and noise compresses badly, so the zstandard ratio (UTF-8 bytes over
compressed bytes) of ordinary prose lies in a band.  The band depends on length: short texts share little with
themselves, long ones much.  The ratio is taken of the whole text and of fixed chunks of it, the last, shorter one by the
band of its length; a text goes when the whole leaves the band of its length, or when more than a stated share of its
bytes lie in chunks that leave theirs.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewing.llm import shared

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """(bytes from which a band holds, least ratio, greatest ratio), ascending; texts below the first are not judged.

    The least ratio between two lengths is interpolated over the logarithm of the length.  The least ratios lie between
    those of prose cut to the length (sf0.1, the least of four languages: 1.14 at 200 bytes, 1.37 at 500, 1.65 at 1,000,
    1.88 at 2,000, 2.06 at 4,000) and of random letters and digits (1.08, 1.24, 1.32, 1.36, 1.38; 1.40 at any length).
    Random letters of one case (1.3 to 1.7) are too near to prose for a ratio to tell.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (200, 1.10, 3.0),
        (350, 1.22, 3.0),
        (500, 1.29, 3.2),
        (700, 1.36, 3.2),
        (1_000, 1.45, 3.4),
        (2_000, 1.50, 3.4),
        (4_000, 1.50, 3.8),
        (16_000, 1.50, 4.2),
        (64_000, 1.50, 4.6),
    )
    chunk_bytes: int = 4_096
    chunk: tuple[float, float] = (1.50, 4.0)
    chunk_share: float = 0.2  # of the bytes of judged chunks that may lie outside
    level: int = 3

    def limits(self, length: int) -> tuple[float, float]:
        """(least, greatest) ratio of a text of ``length`` bytes."""
        at = bisect_right(self.whole, length, key=lambda x: x[0])
        if not at:
            return 0.0, float("inf")
        start, least, most = self.whole[at - 1]
        if at < len(self.whole):
            end, after, _ = self.whole[at]
            least += (after - least) * math.log(length / start) / math.log(end / start)
        return least, most


@lru_cache(maxsize=4)
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)


def compression_verdict(text: bytes, bands: Bands) -> tuple[float, float, bool]:
    """(ratio of the whole, share of its judged bytes in chunks outside their band, kept)."""
    if not text:
        return 1.0, 0.0, True
    squeeze = _compressor(bands.level).compress
    ratio = len(text) / len(squeeze(text))
    least, most = bands.limits(len(text))
    kept = least <= ratio <= most
    if len(text) < bands.chunk_bytes:  # the only chunk is the whole
        return ratio, float(not kept), kept
    judged = outside = 0
    for at in range(0, len(text), bands.chunk_bytes):
        part = text[at : at + bands.chunk_bytes]
        if len(part) < bands.chunk_bytes and len(part) < bands.whole[0][0]:
            break
        low, high = bands.chunk if len(part) == bands.chunk_bytes else bands.limits(len(part))
        judged += len(part)
        outside += 0 if low <= len(part) / len(squeeze(part)) <= high else len(part)
    share = outside / judged
    return ratio, share, kept and share <= bands.chunk_share


def repeated_words(hashes: np.ndarray, width: int = 8) -> int:
    """Words that lie in a window of ``width`` words found twice or more, first finds included."""
    windows = shared.window_hashes(hashes, width)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(again)
    edge[at] += 1  # each window starts once
    np.subtract.at(edge, at + width, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    found = 0
    for line in text.split(b"\n"):
        if line.strip(shared.WORD_GAPS):
            if line in seen:
                found += 1
            seen.add(line)
    return found


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, outside_share double"
)
_FIELDS = [f.split() for f in RESULT.split(", ")]
_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def measure(column: pa.Array, bands: Bands) -> pa.StructArray:
    """The columns of RESULT for each text of an Arrow column."""
    rows: dict[str, list] = {name: [] for name, _ in _FIELDS}
    for _, _, data, offsets in shared.slices(column):
        starts, ends, first = shared.word_spans(data, offsets)
        hashes = shared.word_hashes(data, starts, ends)
        whole = data.tobytes()
        lengths = np.concatenate([[0], np.cumsum(ends - starts)])
        trailing = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data & 0xC0) == 0x80, out=trailing[1:])  # bytes that continue a character are all inside words
        for i in range(len(offsets) - 1):
            text, a, b = whole[offsets[i] : offsets[i + 1]], first[i], first[i + 1]
            n = int(b - a)
            repeat = repeated_words(hashes[a:b])
            failed = n < 20 or 100 * repeat > 30 * n
            ratio, share, good = compression_verdict(text, bands)
            rows["n_words"].append(n)
            rows["word_chars"].append(int(lengths[b] - lengths[a] - (trailing[offsets[i + 1]] - trailing[offsets[i]])))
            rows["n_symbols"].append(sum(text.count(bytes([c])) for c in SYMBOLS))
            rows["n_dup_lines"].append(duplicate_lines(text))
            rows["n_repeat_words"].append(repeat)
            rows["base_failed"].append(failed)
            rows["kept"].append(good and not failed)
            rows["ratio"].append(ratio)
            rows["outside_share"].append(share)
    return pa.StructArray.from_arrays(
        [pa.array(rows[name], _ARROW[kind]) for name, kind in _FIELDS], names=[name for name, _ in _FIELDS]
    )


def with_quality(docs: DataFrame, text: str = "text", into: str = "quality", bands: Bands | None = None) -> DataFrame:
    """``docs`` with a struct column ``into`` of the measures in RESULT, one row out for each row in.

    Null and empty texts have no words: they fail the base rule. Repeated rows and ties are judged alike, each on its
    own; an empty table gives an empty table. A column of the name ``into``, in any case, is replaced. No shuffle; a task holds one Arrow batch.
    """
    limits = bands or Bands()

    @F.arrow_udf(f"struct<{', '.join(f'{n}: {k}' for n, k in _FIELDS)}>".replace("long", "bigint"))
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in shared.lean(batches):
            yield measure(batch, limits)

    return docs.withColumn(into, judged(F.col(text)))


def keep_good(docs: DataFrame, text: str = "text", bands: Bands | None = None) -> DataFrame:
    """The rows of ``docs`` whose text passes all rules, with the columns of ``docs``.

    Same cases as ``with_quality``; clashing column names cannot occur, the measures live in one column of a new name.
    """
    (into,) = shared.free_names(docs.columns, "quality")
    return with_quality(docs, text, into, bands).where(F.col(f"{into}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality(docs).select("doc_id", "quality.*")
