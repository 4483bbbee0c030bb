"""All links of an n-gram Jaccard join, and their components, by PartEnum signatures.

Sets at Jaccard similarity s or more have sizes within a factor s, so sizes are cut into bands and only sets of one band
or of two neighbours can link.  In a pair of bands such sets differ in at most k elements.  The domain of elements is cut
into parts; of k + 1 parts two linked sets agree on a whole one.  Of half as many, some part has at most one difference;
cut into three, it has two thirds on which the sets agree, and the three subsets of two thirds are enumerated.  Small
bands use subsets (more selective), large ones whole parts (fewer signatures).  Either way linked sets share a signature
for certain.  There are more parts than that, so that linked sets agree on several, a; each set leaves out its a - 1
smallest.  It still has one of those it agrees on, and the set whose smallest kept part is larger decides for both.

Equal sets are one vertex.  Signatures travel packed: a block of some thousand documents sends, for each range of
signatures, one row of sorted 32-bit remainders and 40-bit vertex numbers; nearly all signatures stand alone and end
there.  What meets is treated by the size of its group:

* Groups of up to ``SMALL`` members give their pairs, a bounded number each.
* In a larger group every member is paired with one leader, the member that stands in most large groups.

A pair is compared only if two sketches allow it: 2,048 bits of parities of element hashes, whose difference never exceeds the
number of differing elements.  Sets that overfill these have wide sketches as well, of one to two bits an element: without them
every two large sets of a leader would be compared by their texts.  What links becomes components.  Members of a leader that are still in different components
then meet by their sketches alone, in blocks inside a task, and only pairs that the sketches allow leave it to be compared.

So a group of near copies costs a comparison for each member and some for those far from the middle, texts are moved only
for pairs that may link, and no link is lost.
All sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latewing.llm import shared

#: Tables of ids are sent to all executors up to this many rows (8 to 24 bytes each).
BROADCAST_IDS = 1_000_000
#: Bands up to this set size enumerate subsets.
SUBSET_SIZE = 200
#: Groups up to this many members give their pairs.
SMALL = 8
#: A block sends its members of a signature by itself if they are more than this.
HOT = 64
#: Signatures of a block, and of a range of signatures that one step of a task resolves.
BLOCK_SIGNATURES, RANGE_SIGNATURES = 1 << 19, 1 << 20
#: Members of a leader in one block; two blocks meet in a task.  A member is sent once for each block of its leader.
BLOCK_MEMBERS = 8192
#: Pairs of members that a task tries at a time.
TRIED = 1 << 16
#: 64-bit words of a sketch.
SKETCH_WORDS = 32
#: Sets with more elements than a sketch has bits get a wide sketch too.
WIDE_FROM = 64 * SKETCH_WORDS


@lru_cache(maxsize=4)
def band_starts(similarity: int, largest: int) -> np.ndarray:
    """First sizes of the bands; a set of size n in one band can link to sizes in its neighbours at most."""
    starts, low = [], 1
    while low <= largest:
        starts.append(low)
        low = low * 100 // similarity + 1
    return np.array([*starts, low, low * 100 // similarity + 1])


@lru_cache(maxsize=1024)
def instance(band: int, similarity: int, largest: int) -> tuple[int, bool, int]:
    """(number of parts, whether subsets are enumerated, parts that linked sets agree on at least), for sets of bands
    ``band`` - 1 and ``band``.

    There are a fifth more parts than k differences need, so linked sets agree on several, not one; a set then leaves out
    its smallest parts, one less than it must agree on.  What is left holds more elements and is met by chance less often.
    """
    top = int(band_starts(similarity, largest)[band + 1]) - 1
    k = (100 - similarity) * 2 * top // (100 + similarity)
    if not k:
        return 1, False, 1  # only equal sets link
    subsets = top <= SUBSET_SIZE
    spoiled = k // 2 if subsets else k  # parts that k differences can spoil
    agreeing = 1 + -(-(spoiled + 1) // 5)
    return spoiled + agreeing, subsets, agreeing


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; with fewer words the whole sequence is one."""
    if not len(words):
        return words
    return np.unique(shared.window_hashes(words, min(width, len(words))))


def signatures(elements: np.ndarray, similarity: int) -> np.ndarray:
    """PartEnum signatures of a set, for its band and the next."""
    n = len(elements)
    out = [np.zeros(0, np.uint64)]
    largest = 1 << max(12, int(n).bit_length())
    band = int(np.searchsorted(band_starts(similarity, largest), n, "right")) - 1
    for which in (band, band + 1) if n else ():
        parts, subsets, agreeing = instance(which, similarity, largest)
        salt = np.uint64(which * 2 + 1) * np.uint64(0x9E37)
        cells = parts * 3 if subsets else parts
        place = (shared.mix64(elements + salt) >> np.uint64(8)) % np.uint64(cells)
        order = np.argsort(place, kind="stable")
        place, sums = place[order], np.concatenate([np.zeros(1, np.uint64), np.cumsum(shared.mix64(elements[order] ^ salt))])
        edges = np.searchsorted(place, np.arange(cells + 1, dtype=np.uint64))
        held = sums[edges[1:]] - sums[edges[:-1]]  # an order-free hash of the elements of each cell
        sizes = np.diff(edges)
        numbers = np.arange(parts, dtype=np.uint64)
        if subsets:
            cell, size = held.reshape(parts, 3), sizes.reshape(parts, 3)
            weakest = size.sum(1) - size.max(1)  # elements of a part's smallest subset
            least = np.partition(weakest, agreeing - 1)[agreeing - 1]
            for a, b in ((0, 1), (0, 2), (1, 2)):
                code = np.uint64(a * 3 + b)
                made = shared.mix64(cell[:, a] + shared.mix64(cell[:, b] + code) + shared.mix64(numbers * np.uint64(16) + code + (salt << np.uint64(32))))
                out.append(made[size[:, a] + size[:, b] >= least])
        else:
            least = np.partition(sizes, agreeing - 1)[agreeing - 1]
            made = shared.mix64(held + shared.mix64(numbers * np.uint64(16) + (salt << np.uint64(32))))
            out.append(made[sizes >= least])
    return np.concatenate(out)


def vertex_of(elements: np.ndarray) -> int:
    """One 64-bit hash of a set; equal sets have equal ones."""
    return int(shared.mix64(elements).sum(dtype=np.uint64))


def sketch(elements: np.ndarray, width: int = SKETCH_WORDS) -> np.ndarray:
    """Parities of element hashes, 64 to a word: two sets' sketches differ in no more bits than the sets in elements."""
    bits = (shared.mix64(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(64 * width)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=64 * width) & 1).astype(np.uint8)).view(np.uint64)


def wide_sketch(elements: np.ndarray) -> bytes | None:
    """A sketch of one to two bits an element, for sets that overfill the usual one."""
    n = len(elements)
    return sketch(elements, 1 << ((n - 1) // 64).bit_length()).tobytes() if n > WIDE_FROM else None


def differing(x: bytes, y: bytes) -> int:
    """Differing bits of two wide sketches, the longer folded to the length of the shorter: no more than elements differ."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(p) < len(q):
        p, q = q, p
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for at, _, data, offsets in shared.slices(column):
        starts, ends, first = shared.word_spans(data, offsets)
        words = shared.word_hashes(data, starts, ends, lower=True)
        for i in range(len(offsets) - 1):
            yield at + i, shingles(words[first[i] : first[i + 1]], width)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_print, text: the first two name a text, whatever ids are repeated or null."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_print"), "text")


def shingle_table(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_print, n_shingles, vertex, sketch, wide (null for small sets) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in shared.lean(batches):
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes, vertices, made, wide = [], [], [np.zeros(0, np.uint64)], []
                for _, elements in _sets(batch.column("text"), width):
                    sizes.append(len(elements))
                    wide.append(wide_sketch(elements))
                    vertices.append(vertex_of(elements))
                    made.append(sketch(elements))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sizes) * SKETCH_WORDS + 1, SKETCH_WORDS, dtype=np.int32)), pa.array(shared.signed(np.concatenate(made))))
                out = [batch.column("doc_id"), batch.column("text_print"), pa.array(sizes, pa.int64()), pa.array(shared.signed(np.array(vertices, np.uint64))), lists, pa.array(wide, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "text_print", "n_shingles", "vertex", "sketch", "wide"])

    return _keyed(docs).mapInArrow(run, "doc_id bigint, text_print bigint, n_shingles bigint, vertex bigint, sketch array<bigint>, wide binary")


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned integers, byte by byte: sorted numbers and their like compress well so."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(raw: bytes, width: int) -> np.ndarray:
    n = len(raw) // width
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return wide.reshape(-1).view("<u8")


def signature_blocks(docs: DataFrame, width: int, similarity: int, bits: int) -> DataFrame:
    """(bucket, hot, signs, ids, told): packed signatures of the distinct sets of a block of documents.

    A signature's first ``bits`` bits are its bucket, the next 32 are kept.  Signatures with more than ``HOT`` members in
    the block are sent in rows marked hot, to any bucket, with all their members and their whole bits; their own bucket
    gets one member and, in ``told``, word of it.  So no bucket gathers more of a signature than HOT for each block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[np.ndarray] = []
        ids: list[int] = []
        seen: set[int] = set()
        held, number = 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            sign = np.concatenate(made) >> np.uint64(32 - bits)
            owner = np.repeat(np.array(ids, np.uint64) >> np.uint64(24), [len(m) for m in made])
            order = np.argsort(sign, kind="stable")
            sign, owner = sign[order], owner[order]
            new = np.ones(len(sign), bool)
            new[1:] = sign[1:] != sign[:-1]
            starts = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            many = np.diff(np.append(starts, len(sign))) > HOT
            rows: list[tuple] = []
            hot = many[run_of]
            if hot.any():
                rows.append((number % (1 << bits), True, sign[hot].tobytes(), _planes(owner[hot], 5), b""))
            keep = ~hot | new
            told = sign[new][many]
            sign, owner = sign[keep], owner[keep]
            edges = np.searchsorted(sign, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
            told_edges = np.searchsorted(told, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
            for bucket in np.flatnonzero(np.diff(edges)).tolist():
                a, b, c, d = edges[bucket], edges[bucket + 1], told_edges[bucket], told_edges[bucket + 1]
                rows.append((bucket, False, _planes(sign[a:b], 4), _planes(owner[a:b], 5), _planes(told[c:d], 4)))
            kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "hot", "signs", "ids", "told"])

        for whole in shared.lean(batches):
            for at in range(0, whole.num_rows, 1000):
                for _, elements in _sets(whole.slice(at, 1000).column(0), width):
                    vertex = vertex_of(elements)
                    if not len(elements) or vertex in seen:
                        continue
                    seen.add(vertex)
                    ids.append(vertex)
                    made.append(signatures(elements, similarity))
                    held += len(made[-1])
                if held >= BLOCK_SIGNATURES:
                    yield flush()
                    made, ids, seen, held, number = [], [], set(), 0, number + 7919
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket int, hot boolean, signs binary, ids binary, told binary")


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows of some columns, sorted by the first."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    keep = np.ones(len(order), bool)
    keep[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return tuple(c[keep] for c in columns)


def met(blocks: DataFrame) -> DataFrame:
    """(large, p, q): pairs of vertex numbers that share a signature in a small group, each once for a bucket; and, for
    large groups, signature and member."""

    def table(large: bool, p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(p), large)), pa.array(p.astype(np.int64)), pa.array(q.astype(np.int64))], names=["large", "p", "q"])

    def resolve(bucket: int, rows: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        signs, ids, told = (np.concatenate([_from_planes(r[i], w) for r in rows]) for i, w in enumerate((4, 5, 4)))
        signs, ids = _distinct(signs, ids)
        new = np.ones(len(signs), bool)
        new[1:] = signs[1:] != signs[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(signs)))
        large = (sizes > SMALL) | np.isin(signs[starts], told)
        pairs = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for n in range(2, SMALL + 1):
            members = ids[starts[(sizes == n) & ~large][:, None] + np.arange(n)]
            pairs += [(members[:, i], members[:, j]) for i in range(n) for j in range(i + 1, n)]
        yield table(False, *_distinct(*(np.concatenate(side) for side in zip(*pairs, strict=True))))
        inside = np.repeat(large, sizes)
        yield table(True, (np.uint64(bucket) << np.uint64(32)) + signs[inside], ids[inside])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = -1, []
        for batch in shared.lean(batches):
            for i in range(batch.num_rows):
                at, hot, *packed = (c[i].as_py() for c in batch.columns)  # one row's bytes at a time
                if hot:
                    yield table(True, np.frombuffer(packed[0], np.uint64), _from_planes(packed[1], 5))
                    continue
                if at != bucket and rows:
                    yield from resolve(bucket, rows)
                    rows = []
                bucket = at
                rows.append(packed)
        if rows:
            yield from resolve(bucket, rows)

    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "large boolean, p bigint, q bigint")


def _small(table: DataFrame, rows: int) -> DataFrame:
    """``table``, to be sent to all executors if its counted rows are few; else Spark joins it by shuffle."""
    return F.broadcast(table) if rows <= BROADCAST_IDS else table


def _allowed(n_x: str, n_y: str, x: str, y: str, similarity: int):
    """Whether two sketches and sizes allow a link."""
    bits = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH_WORDS)), F.lit(0))
    fits = F.least(n_x, n_y) * 100 >= F.greatest(n_x, n_y) * similarity
    return fits & (bits * (100 + similarity) <= (F.col(n_x) + F.col(n_y)) * (100 - similarity))


def _side(candidates: DataFrame, end: str) -> DataFrame:
    return candidates.select(F.col("vid").alias(f"{end}_vid"), F.col("vertex").alias(end), F.col("n").alias(f"{end}_n"), F.col("sketch").alias(f"{end}_sketch"))


def _near_pairs(pairs: DataFrame, candidates: DataFrame, similarity: int) -> DataFrame:
    """(a, b) vertices of ``pairs``, (p, q) of vertex numbers or (a, b) of vertices, whose sketches allow a link."""
    on_a, on_b = ((F.col("p") == F.col("a_vid"), F.col("q") == F.col("b_vid")) if "p" in pairs.columns else ("a", "b"))
    both = pairs.join(_side(candidates, "a"), on_a).join(_side(candidates, "b"), on_b)
    return both.where(_allowed("a_n", "b_n", "a_sketch", "b_sketch", similarity)).select("a", "b")


def _told_apart(pairs: DataFrame, candidates: DataFrame, similarity: int) -> DataFrame:
    """The ``pairs`` (a, b) of vertices without those of two large sets whose wide sketches allow no link."""
    wide = candidates.where("wide is not null")
    for end in ("a", "b"):
        pairs = pairs.join(wide.select(F.col("vertex").alias(end), F.col("n").alias(f"{end}_n"), F.col("wide").alias(f"{end}_wide")), end, "left")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.lean(batches):
            keep = np.ones(batch.num_rows, bool)
            for i, (x, y, n, m) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a_wide", "b_wide", "a_n", "b_n")), strict=True)):
                if x is not None and y is not None:
                    keep[i] = differing(x, y) * (100 + similarity) <= (n + m) * (100 - similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    large = pairs.where("a_wide is not null and b_wide is not null").select("a", "b", "a_n", "b_n", "a_wide", "b_wide")
    return pairs.where("a_wide is null or b_wide is null").select("a", "b").unionByName(large.mapInArrow(told, "a bigint, b bigint"))


def _leader_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every vertex of ``members`` (signature, vertex) with the leaders of its large groups."""
    degrees = members.groupBy("vertex").agg(F.count("*").alias("degree"))
    leaders = members.join(degrees, "vertex").groupBy("signature").agg(F.max_by("vertex", F.struct("degree", "vertex")).alias("a"))
    return members.join(leaders, "signature").where("vertex <> a").select("a", F.col("vertex").alias("b")).distinct()


def _compared(pairs: DataFrame, texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """The ``pairs`` (a, b) whose sets reach the similarity, by their ``texts`` (vertex, text).

    The two texts meet by joins whose hot keys Spark splits.
    """
    mine = texts.select(F.col("vertex").alias("b"), F.col("text").alias("b_text"))
    theirs = texts.select(F.col("vertex").alias("a"), F.col("text").alias("a_text"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for whole in shared.lean(batches):
            leaders, linked = whole.column("a").to_pylist(), np.zeros(whole.num_rows, bool)
            for i, other in _sets(whole.column("b_text"), width):
                if leaders[i] not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[leaders[i]] = next(_sets(whole.column("a_text").slice(i, 1), width))[1]
                own = known[leaders[i]]
                common = len(np.intersect1d(own, other, assume_unique=True))
                linked[i] = 100 * common >= similarity * (len(own) + len(other) - common)
            yield whole.select(["a", "b"]).filter(pa.array(linked))

    both = pairs.join(mine, "b").join(theirs, "a").select("a", "b", "b_text", "a_text")
    return both.mapInArrow(compare, "a bigint, b bigint")


def _far_pairs(stars: DataFrame, roots: DataFrame, candidates: DataFrame, similarity: int) -> DataFrame:
    """(a, b), a < b: vertices with the same leader, or a leader and its member, in different components, whose sketches
    allow a link.

    A leader's members are dealt into blocks of bounded size and every two blocks meet in a task; leaders whose members
    are one component are left out.
    """
    sides = stars.unionByName(stars.select("a", F.col("a").alias("b")).distinct())
    sides = sides.join(roots.select(F.col("id").alias("b"), "root"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    leaders = sides.groupBy("a").agg(F.count("*").alias("m"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    sides = sides.join(leaders.select("a", F.ceil(F.col("m") / BLOCK_MEMBERS).cast("int").alias("blocks")), "a")
    sides = sides.join(candidates.select(F.col("vertex").alias("b"), "n", "sketch", "wide"), "b").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    met_by = sides.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = met_by.select("a", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "b", "root", "n", "sketch", "wide")

    def tried(key: tuple, table: pa.Table) -> pa.Table:
        b, root, n, block = (table.column(c).to_numpy() for c in ("b", "root", "n", "block"))
        sketches = table.column("sketch").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH_WORDS)
        wide = table.column("wide").to_pylist()
        low, high = key[1].as_py(), key[2].as_py()
        xs, ys = np.flatnonzero(block == low), np.flatnonzero(block == high)
        found = []
        step = max(1, TRIED // max(1, len(ys)))
        for at in range(0, len(xs), step):
            x = xs[at : at + step]
            fits = (root[x, None] != root[None, ys]) & (100 * np.minimum(n[x, None], n[None, ys]) >= similarity * np.maximum(n[x, None], n[None, ys]))
            if low == high:
                fits &= b[x, None] < b[None, ys]
            p, q = np.nonzero(fits)
            p, q = x[p], ys[q]
            near = np.bitwise_count(sketches[p] ^ sketches[q]).sum(1) * (100 + similarity) <= (100 - similarity) * (n[p] + n[q])
            for i in np.flatnonzero(near & (n[p] > WIDE_FROM) & (n[q] > WIDE_FROM)).tolist():
                near[i] = differing(wide[p[i]], wide[q[i]]) * (100 + similarity) <= (100 - similarity) * (n[p[i]] + n[q[i]])
            found.append(np.stack([np.minimum(b[p[near]], b[q[near]]), np.maximum(b[p[near]], b[q[near]])]))
        pairs = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return dealt.groupBy("a", "low", "high").applyInArrow(tried, "a bigint, b bigint").distinct()


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, root) of every vertex of ``edges`` (a, b) but the roots, root being the smallest id of its component.

    Large-star and small-star steps: every vertex hands its larger, then its smaller neighbours to the smallest of them;
    the edges become stars in a number of rounds that grows as the logarithm of the component's size.  Each round is
    written to the shared folder, so plans stay short and lost executors cost little.  An error if 99 rounds don't do.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = shared.stored(e, folder, f"{name}-0")
    mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for i in range(1, 100):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = shared.stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), folder, f"{name}-{i}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        shared.drop_stored(e.sparkSession, f"{folder}/{name}-{i - 1}")
        if now == mark:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError("components did not settle in 99 rounds")


def _texts_of(docs: DataFrame, pairs: DataFrame, candidates: DataFrame, folder: str, name: str) -> DataFrame:
    """(vertex, text) of the vertices in ``pairs``: one pass over the texts, and one shuffle that both sides of a comparison
    share."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    rows = shared.stored(candidates.join(used, "vertex").select("vertex", F.col("row.doc_id").alias("_id"), F.col("row.text_print").alias("_print")), folder, f"{name}-rows")
    texts = _keyed(docs).join(_small(rows, rows.count()), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_print") == F.col("_print")))
    return texts.select("vertex", "text").dropDuplicates(["vertex"])


def set_components(docs: DataFrame, folder: str, width: int, similarity: int) -> DataFrame:
    """doc_id, text_print, n_shingles, component of every row of ``docs`` (doc_id, text), stored; ``component`` names the
    rows that links join by a number of its own, null for empty sets."""
    made = shared.stored(shingle_table(docs, width), folder, "shingles")
    filled = made.where("n_shingles > 0")
    elements = filled.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    bits = max(0, (elements // RANGE_SIGNATURES).bit_length())
    meeting = shared.stored(met(signature_blocks(docs, width, similarity, bits)), folder, "met")
    pairs = shared.stored(meeting.where("not large").select("p", "q").distinct(), folder, "small")
    held = meeting.where("large").select(F.col("p").alias("signature"), F.col("q").alias("vid"))
    wanted = shared.stored(pairs.select(F.explode(F.array("p", "q")).alias("vid")).unionByName(held.select("vid")).distinct(), folder, "wanted")
    vid = F.shiftrightunsigned("vertex", 24)
    row = F.min(F.struct("doc_id", "text_print")).alias("row")
    candidates = filled.withColumn("vid", vid).join(_small(wanted, wanted.count()), "vid", "left_semi").groupBy("vertex", "vid")
    candidates = shared.stored(candidates.agg(row, F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")), folder, "candidates")
    members = shared.stored(held.join(candidates.select("vid", "vertex"), "vid").select("signature", "vertex").distinct(), folder, "members")
    stars = shared.stored(_leader_pairs(members), folder, "stars")
    near = _near_pairs(pairs, candidates, similarity).unionByName(_near_pairs(stars, candidates, similarity))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = shared.stored(_told_apart(near, candidates, similarity), folder, "near")
    roots = None
    links = shared.stored(_compared(near, _texts_of(docs, near, candidates, folder, "near"), width, similarity), folder, "links")
    if not links.isEmpty():
        roots = components(links, folder, "round")
    still = roots if roots is not None else links.selectExpr("a as id", "b as root")
    far = shared.stored(_far_pairs(stars, still, candidates, similarity).join(near, ["a", "b"], "left_anti"), folder, "far")
    if not far.isEmpty():
        more = shared.stored(_compared(far, _texts_of(docs, far, candidates, folder, "far"), width, similarity), folder, "more")
        if not more.isEmpty():
            roots = components(links.unionByName(more), folder, "all")
    named = made.withColumn("component", F.when(F.col("n_shingles") > 0, F.col("vertex")))
    if roots is not None:
        named = named.join(_small(roots, roots.count()), F.col("component") == F.col("id"), "left").withColumn("component", F.coalesce("root", "component"))
    return shared.stored(named.select("doc_id", "text_print", "n_shingles", "component"), folder, "components")


def jaccard_components(docs: DataFrame, folder: str, width: int = 3, similarity: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Texts are lower-cased (A-Z) and cut into words; a document's set are its distinct shingles of ``width`` words, or the
    whole sequence if it has fewer.  Documents link when 100 * intersection >= ``similarity`` * union; component_id is
    the smallest doc_id reachable.  Null, empty and blank texts have an empty set and link with nothing.  Repeated rows
    and equal texts link.  Rows of one doc_id with different texts are documents of their own that share a name; null
    ids take part, and a component of null ids alone has a null component_id.  An empty table gives an empty table.
    Other columns are not read.
    """
    found = set_components(docs, folder, width, similarity)
    named = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(named, "component", "left").select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, folder: str, width: int = 5, similarity: int = 80) -> DataFrame:
    """``docs`` with one row of every component: the one with the smallest doc_id (null last), of equal ids the one with
    the smallest hash of its text, of rows that repeat both any one.  Rows with an empty set are components of their own.

    Columns pass through, whatever their names.  Other cases as in ``jaccard_components``.
    """
    found = set_components(docs, folder, width, similarity)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_print")
    kept = found.where("component is not null").groupBy("component").agg(F.min(place).alias("kept"))
    kept = kept.select("component", F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_print").alias("kept_print"))
    rows = found.groupBy("doc_id", "text_print", "component").agg(F.count("*").alias("n"))
    same = F.col("component").isNull() | (F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_print") == F.col("kept_print")))
    judged = rows.join(kept, "component", "left").withColumn("is_kept", same)
    odd = shared.stored(judged.where("not is_kept or n > 1").select("doc_id", "text_print", "is_kept"), folder, "odd")
    key, text_print, again = shared.free_names(docs.columns, "id", "print", "kept")
    odd = _small(odd.select(F.col("doc_id").alias(key), F.col("text_print").alias(text_print), F.col("is_kept").alias(again)), odd.count())
    marked = docs.join(odd, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text_print)), "left")
    once = marked.where(F.col(again)).withColumn(again, F.row_number().over(Window.partitionBy(key, text_print).orderBy(F.lit(0)))).where(F.col(again) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(F.col(again).isNull()).select(*columns).unionByName(once.select(*columns))


def op10(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(shared.table(spark, sf_dir, "documents"), shared.shared_folder(spark))


SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when coalesce(len(w), 0) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
  from words
), items as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (
  select a.doc_id as x, b.doc_id as y from items a join items b on a.g = b.g and a.doc_id < b.doc_id and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))
), edges as (select x, y from pairs union all select y, x from pairs),
reach(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, e.y from reach r join edges e on r.other = e.x
)
select doc_id, cast(len(s) as bigint) as n_shingles, (select min(other) from reach where reach.doc_id = sets.doc_id) as component_id from sets
"""
