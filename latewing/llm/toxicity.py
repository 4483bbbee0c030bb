"""Toxicity by a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text is the set of its character n-grams, hashed to buckets; n-grams reach over the edges of a word but never over more
than one word.  From labelled texts each bucket gets the logarithm of the ratio of its smoothed shares among toxic and
other texts; the features of a text are these ratios, and a logistic regression weighs them.

Learning is a series of Spark jobs over a sample of labelled texts of at most ``Settings.most_rows`` rows, written once:
counts of buckets are summed per range of buckets, buckets that tell nothing are dropped, and every step of the
optimiser (limited-memory BFGS) sums gradients over the tasks.  The driver holds vectors of at most
``most_features`` numbers, never a text.  Scoring is a narrow pass over whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewing.llm import shared


@dataclass(frozen=True)
class Settings:
    """``most_rows`` bounds the labelled rows that are learned from (those of the least hash of their id); all else covers
    every row."""

    orders: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    bits: int = 20
    least_docs: int = 4  # labelled texts that hold a feature
    least_z: float = 3.0  # of the difference of its shares
    most_features: int = 1 << 16
    smoothing: float = 1.0
    penalty: float = 0.1
    most_steps: int = 80
    most_rows: int = 40_000
    tasks: int = 32
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    """``slots[bucket]`` is a feature's place in ``weights`` or -1; weights are ratio times weight of the regression."""

    settings: Settings
    slots: np.ndarray
    weights: np.ndarray
    bias: float


_SPACE = 0x20
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(max(n, 1), base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Grams:
    """Buckets of the n-grams of texts, in pieces of bounded size; keeps its tables between texts."""

    #: Characters worked on at a time; pieces overlap by the longest n-gram.
    PIECE = 100_000

    def __init__(self, settings: Settings):
        self.orders = settings.orders
        self.shift = np.uint64(64 - settings.bits)
        self.reach = max(settings.orders) - 1
        self.up = _powers(_BASE, self.PIECE + self.reach)
        self.down = _powers(_INVERSE, self.PIECE + self.reach)
        self.salts = shared.spread(max(self.orders) + 1, 900)

    def of(self, text: str | None) -> Iterator[np.ndarray]:
        """Buckets, with repeats, of a text: lower case, white space as one space, a space at both ends."""
        if not text or not (words := text.lower().split()):
            return
        codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(codes), self.PIECE):
            own = min(self.PIECE, len(codes) - at)
            yield self._piece(codes[at : at + own + self.reach], own)

    def _piece(self, codes: np.ndarray, own: int) -> np.ndarray:
        """The n-grams that start in the first ``own`` characters."""
        n = len(codes)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(shared.mix64(codes.astype(np.uint64)) * self.up[:n], out=sums[1:])
        spaces = np.zeros(n + 1, np.int32)
        np.cumsum(codes == _SPACE, out=spaces[1:])
        out = []
        for order in self.orders:
            count = min(own, n - order + 1)
            if count <= 0:
                continue
            inner = np.flatnonzero(spaces[order - 1 : order - 1 + count] == spaces[1 : 1 + count])
            hashes = (sums[inner + order] - sums[inner]) * self.down[inner]
            out.append(((hashes ^ (hashes >> np.uint64(29))) * self.salts[order]) >> self.shift)
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def labelled(labels: DataFrame, settings: Settings, doc_id: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """(id, toxic) of at most ``most_rows`` labelled ids. Null labels and ids, and ids with both labels, are left out."""
    value = F.col(toxic).cast("int")
    known = labels.where(value.isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id"))
    sure = known.agg(F.min(value).alias("toxic"), F.max(value).alias("most")).where("toxic = most").drop("most")
    return sure.orderBy(F.xxhash64("id"), "id").limit(settings.most_rows)


def _sample(docs: DataFrame, labels: DataFrame, settings: Settings, folder: str, doc_id: str, toxic: str, text: str) -> DataFrame:
    """(text, toxic) of the labelled rows, written once; ``labelled`` bounds what is broadcast, so texts stay in place."""
    known = labelled(labels, settings, doc_id, toxic)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")
    return shared.stored(rows.select("text", "toxic").repartition(settings.tasks, F.xxhash64("id")), folder, "sample")


#: Buckets whose counts travel in one row.
_RANGE = 4_096


def _counts(settings: Settings) -> Callable:
    """Texts of each label that hold each bucket, as one row per range of buckets and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(settings)
        held = np.zeros((2, 1 << settings.bits), np.int32)
        rows = np.zeros(2, np.int64)
        for batch in shared.lean(batches):
            marks = _column(batch, "toxic").to_numpy()
            for value, mark in zip(_column(batch, "text"), marks, strict=True):
                pieces = list(grams.of(value.as_py()))
                rows[mark] += 1
                if pieces:
                    held[mark][np.unique(np.concatenate(pieces))] += 1
        parts = [(-1, rows)] if rows.any() else []
        for at in range(0, 1 << settings.bits, _RANGE):
            part = held[:, at : at + _RANGE]
            if part.any():
                parts.append((at, part))
        for at, part in parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([part.astype(np.int64).tobytes()], pa.binary())], names=["at", "counts"]
            )

    return count


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums rows of the same range that one task meets."""
    sums: dict[int, np.ndarray] = {}
    for batch in shared.lean(batches):
        for at, blob in zip(*batch.columns, strict=True):
            part = np.frombuffer(blob.as_buffer(), np.int64)
            sums[at.as_py()] = sums[at.as_py()] + part if at.as_py() in sums else part
    for at, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["at", "counts"])


def _telling(settings: Settings, toxic: int, others: int) -> Callable:
    """(bucket, ratio, z) of the features of each range whose shares differ for certain."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.lean(batches):
            for at, blob in zip(*batch.columns, strict=True):
                if at.as_py() < 0:
                    continue
                none, some = np.frombuffer(blob.as_buffer(), np.int64).reshape(2, -1).astype(float)
                share = (none + some) / (toxic + others)
                spread = np.sqrt(np.maximum(share * (1 - share) * (1 / toxic + 1 / others), 1e-12))
                z = np.abs(some / toxic - none / others) / spread
                a = settings.smoothing
                ratio = np.log((some + a) / (toxic + 2 * a)) - np.log((none + a) / (others + 2 * a))
                keep = np.flatnonzero((none + some >= settings.least_docs) & (z > settings.least_z))
                columns = [pa.array((keep + at.as_py()).astype(np.int32)), pa.array(ratio[keep]), pa.array(z[keep])]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "ratio", "z"])

    return choose


def _features(settings: Settings, slots: np.ndarray) -> Callable:
    """(toxic, places of the features that a text holds)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(settings)
        for batch in shared.lean(batches):
            found = []
            for value in _column(batch, "text"):
                pieces = [slots[p] for p in grams.of(value.as_py())]
                places = np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, np.int32)
                found.append(places[places >= 0])
            flat = np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([_column(batch, "toxic"), lists], names=["toxic", "places"])

    return find


def _slope(ratios: np.ndarray, w: np.ndarray) -> Callable:
    """One row per task: loss, gradient and the gradient of the bias over its texts."""

    def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope, effect = 0.0, np.zeros(len(w)), ratios * w[:-1]
        for batch in shared.lean(batches):
            lists = _column(batch, "places")
            places, rows = lists.flatten().to_numpy(), len(batch)
            row = np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy()))
            y = _column(batch, "toxic").to_numpy()
            s = np.bincount(row, effect[places], rows) + w[-1]
            loss += float(np.logaddexp(0, s).sum() - s[y == 1].sum())
            off = 1 / (1 + np.exp(-np.clip(s, -40, 40))) - y
            slope[:-1] += np.bincount(places, off[row], len(ratios)) * ratios
            slope[-1] += off.sum()
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], names=["loss", "slope"])

    return gradient


def _fitted(features: DataFrame, ratios: np.ndarray, settings: Settings) -> np.ndarray:
    """Weights and bias of least penalised loss."""

    def cost(w: np.ndarray) -> tuple[float, np.ndarray]:
        parts = features.mapInArrow(_slope(ratios, w), "loss double, slope binary").collect()
        loss = math.fsum(p.loss for p in parts) + settings.penalty / 2 * float(w[:-1] @ w[:-1])
        slope = np.sum([np.frombuffer(p.slope) for p in sorted(parts, key=lambda p: p.loss)], axis=0)
        slope[:-1] += settings.penalty * w[:-1]
        return loss, slope

    w = np.zeros(len(ratios) + 1)
    loss, slope = cost(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(settings.most_steps):
        way, used = slope.copy(), []
        for move, change in reversed(moves):
            used.append(move @ way / (change @ move))
            way -= used[-1] * change
        way *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(np.linalg.norm(slope), 1e-12)
        for (move, change), was in zip(moves, reversed(used), strict=True):
            way += move * (was - change @ way / (change @ move))
        length = 1.0
        while True:
            after = w - length * way
            new_loss, new_slope = cost(after)
            if new_loss <= loss - 1e-4 * length * (slope @ way) or length < 1e-6:
                break
            length /= 2
        move, change = after - w, new_slope - slope
        if move @ change > 0:
            moves = [*moves[-9:], (move, change)]
        gained, w, loss, slope = loss - new_loss, after, new_loss, new_slope
        if gained < 1e-4 * abs(loss):
            break
    return w


def learn(
    docs: DataFrame, labels: DataFrame, folder: str, settings: Settings | None = None, doc_id: str = "doc_id", toxic: str = "toxic", text: str = "text"
) -> Model:
    """The classifier of the labelled rows of ``docs``; ``folder`` is a shared one, for the sample.

    Null texts count as empty.  Rows that share an id all take its label.  Without a text of either label there are no
    features and every text scores the share of toxic ones among the labelled, one half without any.
    """
    settings = settings or Settings()
    sample = _sample(docs, labels, settings, folder, doc_id, toxic, text)
    counted = sample.mapInArrow(_counts(settings), "at int, counts binary")
    summed = shared.stored(counted.repartition(settings.tasks, "at").mapInArrow(_added, "at int, counts binary"), folder, "counts")
    totals = summed.where("at = -1").collect()
    others, some = (int(n) for n in np.frombuffer(totals[0].counts, np.int64)) if totals else (0, 0)
    slots = np.full(1 << settings.bits, -1, np.int32)
    if not some or not others:
        share = (some + 1) / (some + others + 2)
        return Model(settings, slots, np.zeros(0), math.log(share / (1 - share)))
    telling = summed.mapInArrow(_telling(settings, some, others), "bucket int, ratio double, z double")
    chosen = telling.orderBy(F.desc("z"), "bucket").limit(settings.most_features).collect()
    ratios = np.array([r.ratio for r in chosen])
    slots[[r.bucket for r in chosen]] = np.arange(len(chosen), dtype=np.int32)
    features = shared.stored(sample.mapInArrow(_features(settings, slots), "toxic int, places array<int>"), folder, "features")
    w = _fitted(features, ratios, settings)
    shared.drop_stored(docs.sparkSession, *(f"{folder}/{name}" for name in ("sample", "counts", "features")))
    return Model(settings, slots, ratios * w[:-1], float(w[-1]))


def score_of(text: str | None, model: Model, grams: Grams) -> float:
    """From 0 to 1; a feature counts once however often the text holds it."""
    total = model.bias
    pieces = [p[p >= 0] for p in (model.slots[b] for b in grams.of(text))]
    if pieces:
        total += float(model.weights[np.unique(np.concatenate(pieces))].sum())
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``into`` (score double, predicted int); a column of that name, in any case, is replaced.

    Null and empty texts score what the classifier says without features.  Each row is scored on its own, whole, so repeated
    rows score alike; an empty table gives an empty table.  No shuffle; a task holds one Arrow batch.
    """

    @F.arrow_udf("struct<score: double, predicted: int>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams(model.settings)
        for batch in shared.lean(batches):
            scores = np.array([score_of(value.as_py(), model, grams) for value in batch], float)
            marks = (scores >= model.settings.threshold).astype(np.int32)
            yield pa.StructArray.from_arrays([pa.array(scores), pa.array(marks)], names=["score", "predicted"])

    return docs.withColumn(into, scored(F.col(text)))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are only for measuring: crc32 of the id as text leaves 1 when divided by 3. Null ids are none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op12(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = shared.table(spark, sf_dir, "labels").where(~held_out())
    model = learn(docs, labels, shared.shared_folder(spark))
    return with_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "toxicity.*")
