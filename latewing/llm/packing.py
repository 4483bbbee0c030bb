"""Packing of documents into sequences of fixed length by best-two-fit.

A sequence is filled greedily, each time with the longest piece that fits.  Then its shortest piece is taken out again
if two unpacked pieces fit the widened gap more tightly than it did.

Pieces are dealt at random into groups of bounded size and each group is packed on its own, so no task sees all of
them.  Sequences that a group could not fill well are taken apart and their pieces dealt again into fewer groups; the
rounds end when all that is left is one group, or a round no longer helps.  A random group has the lengths of the whole,
so the groups together need hardly more sequences than one packing of everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewing.llm import shared
from latewing.llm.tokenfile import default_vocabulary
from latewing.llm.tokenizing import crc_of, encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of every document of (doc_id, text): its ids and ``end_id``, cut at ``capacity`` if longer.

    Columns: doc_id, piece, start, length, ids_crc32, and ids (little-endian 32-bit) if asked for.  Null and empty texts
    give one piece of ``end_id`` alone.  Repeated rows each give their pieces.  Other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(vocabulary)
        end = np.array([end_id], tok.dtype)
        for batch in shared.lean(batches, tok.forget):
            rows: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([tok.encode(text.as_py()), end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    made = (doc_id, k, at, len(part), crc_of(part)) + ((part.astype("<u4").tobytes(),) if with_ids else ())
                    for row, value in zip(rows, made, strict=True):
                        row.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=names[: len(rows)])

    return docs.select("doc_id", "text").mapInArrow(encode, PIECES + (", ids binary" if with_ids else ""))


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length.  A set of the lengths that are left is kept as the bits of one integer, so that the
    longest length up to a limit is the highest bit below it."""
    order = np.argsort(lengths, kind="stable")
    bounds = np.searchsorted(lengths[order], np.arange(capacity + 2))
    left = np.diff(bounds).tolist()  # pieces of each length that are unpacked
    taken = [0] * (capacity + 1)
    mask = sum(1 << n for n in range(1, capacity + 1) if left[n])
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def use(n: int) -> None:
        nonlocal mask
        left[n] -= 1
        if not left[n]:
            mask &= ~(1 << n)

    def longest(limit: int) -> int:
        return (mask & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 else -1

    number = 0
    while mask:
        inside, gap = [], capacity
        while gap and (n := longest(gap)) > 0:
            inside.append(n)
            use(n)
            gap -= n
        if gap and mask:
            least = inside.pop()  # greedy filling goes down in length, so the last is the shortest
            wide, best, pair = gap + least, least, None
            a = longest(wide - 1)
            while a > 0 and 2 * a > best:  # a is the longer of the two
                b = longest(min(a, wide - a))
                if b == a and left[a] < 2:
                    b = longest(min(a - 1, wide - a))
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == wide:
                        break
                a = longest(a - 1)
            if pair:
                left[least] += 1
                mask |= 1 << least
                for n in pair:
                    inside.append(n)
                    use(n)
            else:
                inside.append(least)
        at = 0
        for n in inside:
            row = order[bounds[n] + taken[n]]
            taken[n] += 1
            bins[row], offsets[row] = number, at
            at += n
        number += 1
    return bins, offsets


def pack(pieces: DataFrame, folder: str, capacity: int, group_rows: int = 20_000, good_fill: float = 0.995, seed: int = 5) -> DataFrame:
    """``pieces`` (with a column length from 1 to ``capacity``) with sequence_id and offset added; columns of these two
    names are replaced, all others pass through, whatever their names.  Columns must be of types that can be grouped.

    Any row takes part, ties and repeated rows too; an empty table gives an empty table.  A row's group is a hash of its
    columns and of its number among its equals, so reruns agree and equal rows spread.  Sequence ids are unique, not
    consecutive.
    """
    given = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    names = [f"c{i}" for i in range(len(given))]  # no clash with the columns made here, whatever the given names are
    length = names[given.index("length")]
    pieces = pieces.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(given, names, strict=True)])
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    schema = f"{kept}, twin bigint, sequence bigint, place bigint, fill bigint"

    def packed(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["order", "twin"], kind="stable")
        bins, offsets = best_two_fit(df[length].to_numpy(), capacity)
        fills = np.bincount(bins, df[length].to_numpy()).astype(np.int64) if len(df) else np.zeros(0, np.int64)
        number = (int(df["group"].iloc[0]) << 32) + bins
        return df[[*names, "twin"]].assign(sequence=number, place=offsets, fill=fills[bins])

    left = pieces.groupBy(*names).agg(F.count("*").alias("twin")).withColumn("twin", F.explode(F.sequence(F.lit(1).cast("long"), F.col("twin"))))
    done: list[DataFrame] = []
    count, rounds = pieces.count(), 0
    while True:
        groups = max(1, -(-count // group_rows))
        salted = left.withColumn("order", F.xxhash64(*names, "twin", F.lit(seed + rounds)))
        dealt = salted.withColumn("group", F.pmod(F.col("order"), F.lit(groups)) + F.lit(rounds << 24))
        made = shared.stored(dealt.groupBy("group").applyInPandas(packed, schema), folder, f"packed{rounds}")
        if groups == 1:
            done.append(made)
            break
        full = F.col("fill") >= int(good_fill * capacity)
        loose = made.where(~full)
        rest = loose.count()
        if not rest or rest > 0.9 * count:
            done.append(made)
            break
        done.append(made.where(full))
        left, count, rounds = loose.select(*names, "twin"), rest, rounds + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    own = [F.col(n).alias(c) for c, n in zip(given, names, strict=True)]
    return out.select(*own, F.col("sequence").alias("sequence_id"), F.col("place").alias("offset"))


def packed_sequences(placed: DataFrame, end_fill: int | None = None) -> DataFrame:
    """(sequence_id, ids) of ``pack`` over pieces that carry their ids: the sequences themselves, one row each.

    A sequence holds at most the capacity, so its group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))


def pack_documents(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pieces of all ``docs`` with their place; see ``cut_pieces`` and ``pack`` for the cases."""
    pieces = cut_pieces(docs, vocabulary or default_vocabulary("word_bpe_49k.json"), end_id, capacity, with_ids)
    return pack(shared.stored(pieces, folder, "pieces"), folder, capacity)


def op9(spark, sf_dir: str) -> DataFrame:
    return pack_documents(shared.table(spark, sf_dir, "documents"), shared.shared_folder(spark))
