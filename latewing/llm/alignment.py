"""Alignment of two tokenizers over whole texts: token groups that cover the same bytes, and counts of linked token pairs.

A text is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B), both over a space and the text.  Tokens are
intervals of bytes.  Where an A and a B token end together, a group of both sides ends; two tokens are linked when their
intervals overlap.

The work inside a task is SQL: every task has a DuckDB of its own, over token interval tables that live in memory.  ASOF
joins find for each token the last one of the other side that it overlaps, and so whether both end together; window sums over
the common ends number the groups, and a range join links an A token with the B tokens from its first to its last.  Both tokenizers end a token before a space that stands between two
other characters (and around such a line feed), so a text is a sequence of *units* there; intervals are made once per
distinct unit that a task meets, and a text's groups and links are joins of its units with theirs.

Spark merges what tasks find.  A task writes one row per block of texts: the texts' results, and for each text the token
pairs that it links, as places in the block's list of distinct pairs.  Counts of pairs are summed over blocks, each block
asks for the counts of its own list, and every text adds up what it linked.  No table of pairs is broadcast; the highest count
of each A id is, at most one row per entry of that vocabulary.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewing.llm import shared
from latewing.llm.tokenizing import TAIL, Encoder, byte_alphabet

#: Characters of text in a block, unless a single text is longer; distinct units that a task remembers.
BLOCK_CHARS = 1_000_000
UNIT_CAP = 400_000

_SPLIT_SPACE = re.compile(r"(?<=\S) (?=\S)").split
_SPLIT_FEED = re.compile(r"(?<=\S)\n(?=\S)").split


class Pieces:
    """The B side: ids and bytes of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a piece reaches over a space: texts cannot be cut at spaces")
        self.bytes = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)
        ]
        self.lead = self.model.encode("\n", num_threads=1)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units end to end, and how many each has.  A unit that starts with a space has it as the space that the
        model adds; others are read behind a line feed, which ends a piece."""
        spaced = [u[1:] if u[0] == " " else f"\n{u}" for u in units]
        skip = len(self.lead)
        found = [ids if u[0] == " " else ids[skip:] for u, ids in zip(units, self.model.encode(spaced, num_threads=1), strict=True)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts


class Bytes:
    """The A side: ids and bytes of a byte-level vocabulary; strings of special tokens are text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, special_as_text=True)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        vocabulary = self.encoder.tok.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            self.bytes[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        self.letters = self.encoder.piece

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units end to end, and how many each has."""
        kind, letters, other = self.encoder.dtype, self.letters, self.encoder.inner
        found = []
        for u in units:
            word = u.rstrip(TAIL)
            if u[0] == " " and word[1:].isalpha() and (u.isascii() or max(u) < "\u0250"):  # one pre-token, and one of its tail
                ids = letters(word)
                found.append(ids + self.encoder.pieces[u[len(word) :]] if len(word) < len(u) else ids)
            else:
                found.append(other[u[1:]] if u[0] == " " and u.split() == [u[1:]] else self._whole(u))
        counts = np.fromiter(map(len, found), np.int64, len(found)) // kind.itemsize
        return np.frombuffer(b"".join(found), kind).astype(np.int64), counts

    def _whole(self, unit: str) -> bytes:
        return np.array(self.encoder.tok.encode_batch_fast([unit], add_special_tokens=False)[0].ids, self.encoder.dtype).tobytes()


@lru_cache(maxsize=1)
def _sides(a_path: str, b_path: str) -> tuple[Bytes, Pieces]:
    gc.set_threshold(100_000, 50, 1000)  # many short-lived lists, no cycles
    return Bytes(a_path), Pieces(b_path)


def units_of(text: str) -> list[str]:
    """Parts of a space and the text that both tokenizers encode each on its own."""
    out: list[str] = []
    for i, line in enumerate(_SPLIT_FEED(text) if "\n" in text else [text]):
        parts = line.split(" ")
        if not all(parts) or len(parts) != len(line.split()):  # other than single spaces between characters
            parts = _SPLIT_SPACE(line)
        if i:
            out += ["\n", parts[0]]
        else:
            out.append(f" {parts[0]}")
        out += [f" {part}" for part in parts[1:]]
    return out


def _spelt(units: list[bytes], ids: np.ndarray, counts: np.ndarray, names: list[bytes]) -> np.ndarray:
    """Whether the tokens of each unit spell it."""
    parts = list(map(names.__getitem__, ids.tolist()))
    if b"".join(parts) == b"".join(units):
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        at = np.cumsum(counts)
        if (counts > 0).all() and np.array_equal(ends[at - 1], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))):
            return np.ones(len(units), bool)
    edges = np.concatenate([[0], np.cumsum(counts)])
    return np.array([b"".join(parts[edges[i] : edges[i + 1]]) == unit for i, unit in enumerate(units)], bool)


class _Numbers(dict):
    """Numbers in the order of first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


#: Token interval tables of new units; bytes are counted over all of them, so the end of a unit is a common end.
_INTERVALS = """
CREATE OR REPLACE TEMP TABLE {side} AS
SELECT k, unit, id, hi, hi - size AS lo FROM new_{side}
"""

#: The last token of the other side that begins before a token ends, and whether they end together.
_LAST = """
CREATE OR REPLACE TEMP TABLE last_{side} AS
SELECT t.k, t.unit, t.id, o.k AS last, (o.hi = t.hi)::INT AS shut
FROM {side} t ASOF JOIN {other} o ON t.hi > o.lo
"""

#: Numbers of groups: common ends before a token.  The first token that overlaps it is the last one that overlaps the token
#: before it, or the next if those two end together.
_GROUPS = """
CREATE OR REPLACE TEMP TABLE group_{side} AS
SELECT k, unit, id, last, sum(shut) OVER w - shut AS grp, lag(shut, 1, 1) OVER w AS opens, lag(last + shut, 1, 0) OVER w AS first
FROM last_{side} WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)
"""

#: An A token overlaps the B tokens from its first to its last.
_LINKS = """
INSERT INTO unit_pairs
SELECT s.unit, (s.id::BIGINT << 32) | b.id AS pair
FROM (SELECT unit, id, unnest(range(first, last + 1)) AS at FROM group_a) s JOIN b ON b.k = s.at
"""

#: Groups of a unit as text.  One thread aggregates, in the order of the rows.
_WRITTEN = """
INSERT INTO units
SELECT unit, count(*) FILTER (NOT side) AS n_a, count(*) FILTER (side) AS n_b, sum(opens) FILTER (NOT side) AS n_groups,
       string_agg(mark || id, '')[2:] AS written
FROM (
  SELECT unit, grp, FALSE AS side, k, id, opens, CASE WHEN opens = 1 THEN ';' ELSE ',' END AS mark FROM group_a
  UNION ALL
  SELECT unit, grp, TRUE, k, id, opens, CASE WHEN opens = 1 THEN '|' ELSE ',' END FROM group_b
  ORDER BY grp, side, k)
GROUP BY unit
"""

_TEXTS = """
SELECT doc, sum(n_a)::BIGINT AS n_a, sum(n_b)::BIGINT AS n_b, sum(n_groups)::BIGINT AS n_groups,
       sha256(string_agg(written, ';' ORDER BY place)) AS written
FROM sequence JOIN units USING (unit) GROUP BY doc
"""

_PAIRS = """
SELECT doc, pair, sum(n)::BIGINT AS times
FROM (SELECT doc, unit, count(*) AS n FROM sequence GROUP BY ALL) JOIN unit_pairs USING (unit)
GROUP BY ALL ORDER BY doc
"""

#: What is known of a text but for the sums over its links.
_DOC = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("n_pairs", pa.int64())]


class Aligner:
    """A DuckDB over the units of one task's texts."""

    def __init__(self, a_path: str, b_path: str):
        import duckdb

        self.a, self.b = _sides(a_path, b_path)
        self.size_a, self.size_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        self.db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        self._reset()

    def _reset(self) -> None:
        self.numbers, self.known, self.bad = _Numbers(), 0, set()
        self.db.execute("CREATE OR REPLACE TABLE unit_pairs (unit INT, pair BIGINT)")
        self.db.execute("CREATE OR REPLACE TABLE units (unit INT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, written VARCHAR)")

    def _meet(self, units: list[str]) -> None:
        """Adds new units, numbered from ``known`` on; those whose tokens do not spell them are bad."""
        spelt = [u.encode() for u in units]
        made = {name: (*side.encode(units), side.bytes) for name, side in (("a", self.a), ("b", self.b))}
        good = np.logical_and.reduce([_spelt(spelt, *m) for m in made.values()])
        self.bad.update((np.flatnonzero(~good) + self.known).tolist())
        if good.any():
            for name, sizes in (("a", self.size_a), ("b", self.size_b)):
                ids, counts, _ = made[name]
                keep = np.repeat(good, counts)
                ids, unit = ids[keep], np.repeat(np.arange(len(units), dtype=np.int32) + self.known, counts)[keep]
                self._show(f"new_{name}", k=np.arange(len(ids)), unit=unit.astype(np.int32), id=ids, size=sizes[ids], hi=np.cumsum(sizes[ids]))
            for template in (_INTERVALS, _LAST, _GROUPS):
                if template is _INTERVALS:
                    self.db.execute(template.format(side="a"))
                    self.db.execute(template.format(side="b"))
                else:
                    self.db.execute(template.format(side="a", other="b"))
                    self.db.execute(template.format(side="b", other="a"))
            self.db.execute(_LINKS)
            self.db.execute(_WRITTEN)
            for name in ("a", "b", "last_a", "last_b", "group_a", "group_b"):
                self.db.execute(f"DROP TABLE {name}")
            self.db.unregister("new_a")
            self.db.unregister("new_b")
        self.known += len(units)

    def _show(self, name: str, **columns: np.ndarray) -> None:
        self.db.register(name, pa.table({key: pa.array(value) for key, value in columns.items()}))

    def block(self, texts: list[str | None]) -> tuple[list[dict], np.ndarray, np.ndarray]:
        """A result for each text, and for all texts end to end the pairs they link and how often."""
        if len(self.numbers) > UNIT_CAP:
            self._reset()
        sequences = [np.fromiter(map(self.numbers.__getitem__, units_of(t)), np.int32) if t else np.zeros(0, np.int32) for t in texts]
        self.a.encoder.forget(UNIT_CAP)  # its units are known here
        if len(self.numbers) > self.known:
            self._meet(list(self.numbers)[self.known :])
        if self.bad:
            bad = np.array(sorted(self.bad), np.int32)
            sequences = [s if not np.isin(s, bad).any() else s[:0] for s in sequences]
        rows = [dict(n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256="", n_pairs=0) for _ in texts]
        units = np.concatenate([*sequences, np.zeros(0, np.int32)]).astype(np.int32)
        if not len(units):
            return rows, np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(s) for s in sequences])
        self._show("sequence", doc=doc, unit=units, place=np.arange(len(units)))
        found = self.db.execute(_TEXTS).fetchnumpy()
        for i, *values in zip(*(found[c] for c in ("doc", "n_a", "n_b", "n_groups", "written")), strict=True):
            rows[int(i)].update(zip(("n_a", "n_b", "n_groups", "groups_sha256"), [*map(int, values[:3]), str(values[3])], strict=True))
        links = self.db.execute(_PAIRS).fetchnumpy()
        self.db.unregister("sequence")
        owner, pair, times = (np.asarray(links[c]) for c in ("doc", "pair", "times"))
        for name, values in (("n_pairs", np.bincount(owner, minlength=len(texts))), ("n_links", np.bincount(owner, times, len(texts)))):
            for row, value in zip(rows, values, strict=True):
                row[name] = int(value)
        return rows, pair.astype(np.int64), times.astype(np.int64)

    def close(self) -> None:
        self.db.close()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(keys, texts) of bounded length."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(*batch.columns, strict=True):
            value = text.as_py()
            if texts and size + len(value or "") > BLOCK_CHARS:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(key.as_py())
            texts.append(value)
            size += len(value or "")
    if texts:
        yield keys, texts


def _aligned(a_path: str, b_path: str) -> Callable:
    """One row per block: results of its texts, their links as places in ``pairs``, and texts that hold each pair."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, aligner, kind = TaskContext.get().partitionId() << 32, None, None

        def rows():
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                yield batch

        try:
            for keys, texts in _blocks(shared.lean(rows())):
                aligner = aligner or Aligner(a_path, b_path)
                found, pairs, times = aligner.block(texts)
                distinct, places = np.unique(pairs, return_inverse=True)
                fields = [pa.array(keys, kind), *(pa.array([r[n] for r in found], t) for n, t in _DOC)]
                docs = pa.StructArray.from_arrays(fields, names=["key", *(n for n, _ in _DOC)])
                columns = [
                    pa.array([number]),
                    pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
                    pa.array([places.astype("<u4").tobytes()], pa.binary()),
                    pa.array([times.astype("<u4").tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), pa.array(distinct)),
                    pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), pa.array(np.bincount(places, minlength=len(distinct)).astype(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "docs", "places", "times", "pairs", "held"])
                number += 1
        finally:
            if aligner:
                aligner.close()

    return align


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text: what the counts of its block's pairs make of its links."""
    for batch in shared.lean(batches):
        for docs, places, times, counts in zip(*batch.columns, strict=True):
            docs = docs.values
            asked = counts.values
            size = len(asked) if asked is not None else 0
            n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
            if size:
                at = asked.field("at").to_numpy()
                n[at] = asked.field("n").to_numpy()
                best[at] = asked.field("best").to_numpy(zero_copy_only=False)
            spots, weight = (np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in (places, times))
            ends = np.cumsum(docs.field("n_pairs").to_numpy())
            sums = []
            for values in (best, n):
                total = np.concatenate([[0], np.cumsum(values[spots] * weight)])
                sums.append(pa.array(total[ends] - total[np.concatenate([[0], ends[:-1]])]))
            names = ["key", "n_a", "n_b", "n_groups", "n_links"]
            columns = [*(docs.field(name) for name in names), *sums, docs.field("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, folder: str, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(results, counts) of all ``docs``; ``folder`` is a shared one.

    ``results`` has a row per row of ``docs``: its key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    ``counts`` has (a_id, b_id, n, best): in how many texts the pair is linked, and whether that is the most of its a_id.
    Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros and an
    empty string.  Repeated rows count as often as they stand; keys may be null or repeat; an empty table gives empty
    tables; no other column is read.  A text of any length is aligned whole, in a block of its own.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    doc = ", ".join([f"key: {kind}", *(f"{n}: {'string' if t == pa.string() else 'bigint'}" for n, t in _DOC)])
    schema = f"block bigint, docs array<struct<{doc}>>, places binary, times binary, pairs array<bigint>, held array<bigint>"
    blocks = shared.stored(docs.select(key, text).mapInArrow(_aligned(a_path, b_path), schema), folder, "blocks")

    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair"))
    counts = shared.stored(pairs.agg(F.sum("x.held").alias("n")).withColumn("a_id", F.shiftright("pair", 32)), folder, "pairs")
    most = counts.groupBy("a_id").agg(F.max("n").alias("most"))  # at most one row per entry of the vocabulary
    counts = counts.join(F.broadcast(most), "a_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))

    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair")
    answers = asked.groupBy("block").agg(F.collect_list(F.struct("at", "n", "best")).alias("counts"))  # of one block's pairs
    joined = blocks.select("block", "docs", "places", "times").join(answers, "block", "left").select("docs", "places", "times", "counts")
    out = f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    named = counts.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b_id"), "n", "best")
    return joined.mapInArrow(_summed, out).withColumnRenamed("key", key), named


def op11(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = shared.table(spark, sf_dir, "documents")
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align(docs, shared.shared_folder(spark), *paths)[0]
