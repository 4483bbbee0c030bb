"""Encoders turn texts and page images into token vectors.

The neural encoder is an interface; the default needs no model: a codebook of vectors, a token's vector being the row
that its hash names.
"""

from __future__ import annotations

import hashlib
import uuid
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewing.errors import EncoderError, EncoderWarning
from latewing.functions import texts
from latewing.schema import PAGE_EMBEDDINGS


class Encoder(Protocol):
    """What search and ingestion need."""

    dim: int

    @classmethod
    def supports_model(cls, model_id: str) -> bool: ...

    def encode_texts(self, queries: Sequence[str]) -> list[np.ndarray]: ...

    def encode_pages(self, pages: DataFrame) -> DataFrame:
        """(file_hash, page_number, n_tokens, dim, flat) of (file_hash, page_number, content)."""
        ...


class EncoderRegistry:
    """Encoder classes in order of registration."""

    def __init__(self):
        self._known: dict[str, type] = {}

    def register(self, name: str, encoder: type) -> type:
        self._known[name] = encoder
        return encoder

    def get_for_model(self, model_id: str) -> type:
        """The first class that supports the model, else the first of all."""
        if not self._known:
            raise EncoderError("no encoder is registered")
        for encoder in self._known.values():
            if encoder.supports_model(model_id):
                return encoder
        warnings.warn(f"no encoder supports {model_id}; the first one is used", EncoderWarning, stacklevel=2)
        return next(iter(self._known.values()))


def codebook_row(word: Column, n: int | Column) -> Column:
    """The codebook row of a word: the first 32 bits of its md5, modulo the number of rows."""
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % (F.lit(n) if isinstance(n, int) else n)).cast("long")


def words_of(text: Column) -> Column:
    """A text's words, all of them."""
    return F.filter(F.split(texts.strip(text), r"(?U)\s+"), lambda w: w != "")


class CodebookEncoder:
    """Deterministic default: every word of a text is a token. ``codebook`` has a row per entry: (row, vec)."""

    def __init__(self, codebook: np.ndarray):
        if codebook.ndim != 2 or not len(codebook):
            raise EncoderError("a codebook is a matrix with rows")
        self.codebook, self.dim = codebook.astype(np.float32), codebook.shape[1]

    @classmethod
    def supports_model(cls, model_id: str) -> bool:
        return "codebook" in model_id.lower()

    def encode_texts(self, queries: Sequence[str]) -> list[np.ndarray]:
        if not queries:
            raise EncoderError("nothing to encode")
        return CodebookModel(self.codebook).load()(list(queries))

    @property
    def model(self) -> CodebookModel:
        return CodebookModel(self.codebook)

    def encode_pages(self, pages: DataFrame) -> DataFrame:
        return encoded(pages, self.model)


@dataclass(frozen=True)
class CodebookModel:
    """Looks the words of a batch of pages up: no join, no token leaves its page."""

    codebook: np.ndarray

    @property
    def dim(self) -> int:
        return self.codebook.shape[1]

    def load(self) -> Callable[[list[str | None]], list[np.ndarray]]:
        book = self.codebook

        def run(contents: list[str | None]) -> list[np.ndarray]:
            rows = [[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % len(book) for w in (text or "").split()] for text in contents]
            return [book[r] if r else np.zeros((0, book.shape[1]), np.float32) for r in rows]

        return run


class Model(Protocol):
    """What ``encoded`` sends to the executors: small enough to be sent, or a path to load from there."""

    dim: int

    def load(self) -> Callable[[list], list[np.ndarray]]:
        """A function of some pages' contents that gives each page's token vectors.  Called once per worker process."""
        ...


@dataclass(frozen=True)
class Head:
    """What follows a model: projection (weights of output by input, and a bias), masks and normalisation.

    ``masks`` gives for each page's contents a factor per token (0 for padding or for what is no image); a masked token
    stays, as a vector of zeros.
    """

    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    masks: Callable[[list], list[np.ndarray]] | None = None
    normalise: bool = False

    def run(self, vectors: list[np.ndarray], contents: list) -> list[np.ndarray]:
        lengths = [len(v) for v in vectors]
        if not sum(lengths):
            width = len(self.weights) if self.weights is not None else 0
            return [np.zeros((0, width or v.shape[1]), np.float32) for v in vectors]
        flat = np.concatenate(vectors).astype(np.float32)
        if self.weights is not None:
            flat = flat @ np.asarray(self.weights, np.float32).T
        if self.bias is not None:
            flat = flat + np.asarray(self.bias, np.float32)
        if self.normalise:
            flat = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)
        if self.masks is not None:
            flat = flat * np.concatenate([np.asarray(m, np.float32) for m in self.masks(contents)])[:, None]
        return np.split(flat, np.cumsum(lengths)[:-1])


#: Models that this worker process has loaded, by their token.
_LOADED: dict[str, Callable] = {}


def encoded(pages: DataFrame, model: Model, head: Head | None = None, batch: int = 4) -> DataFrame:
    """(file_hash, page_number, n_tokens, dim, flat) of pages (file_hash, page_number, content), ``flat`` as bytes.

    Pages go through the model ``batch`` at a time, and head and packing follow in the same kernel: nothing is shuffled.
    A worker process loads the model once.  A null content has what the model makes of it; pages keep their rows.
    """
    head, token = head or Head(), uuid.uuid4().hex
    dim = len(head.weights) if head.weights is not None else model.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _LOADED:
            _LOADED.clear()
            _LOADED[token] = model.load()
        work = _LOADED[token]
        for whole in batches:
            for at in range(0, len(whole), batch):
                part = whole.slice(at, batch)
                contents = part.column(2).to_pylist()
                vectors = head.run(work(contents), contents)
                if len(vectors) != len(contents) or any(v.ndim != 2 or v.shape[1] != dim for v in vectors):
                    raise EncoderError(f"the model does not give vectors of width {dim} for each page")
                counts = pa.array([len(v) for v in vectors], pa.int32())
                flat = pa.array([np.ascontiguousarray(v, "<f4").tobytes() for v in vectors], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), counts, pa.array([dim] * len(part), pa.int32()), flat], names=PAGE_EMBEDDINGS.fieldNames())

    return pages.select("file_hash", "page_number", "content").mapInArrow(run, PAGE_EMBEDDINGS)


def unpacked(encodings: DataFrame) -> DataFrame:
    """``encodings`` with ``vectors``, a list of lists, in the place of n_tokens, dim and flat."""
    others = [c for c in encodings.columns if c not in ("n_tokens", "dim", "flat")]

    @F.arrow_udf("array<array<float>>")
    def lists(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for dims, flats in columns:
            rows = [np.frombuffer(f.as_buffer(), "<f4").reshape(-1, max(d, 1)).tolist() for d, f in zip(dims.to_pylist(), flats, strict=True)]
            yield pa.array(rows, pa.list_(pa.list_(pa.float32())))

    return encodings.select(*others, lists("dim", "flat").alias("vectors"))


ENCODERS = EncoderRegistry()
ENCODERS.register("codebook", CodebookEncoder)
