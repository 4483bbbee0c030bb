import random

import numpy as np
import pytest

from latewing.llm import jaccard, passages, shared, topk
from tests.llm.helpers import LOWER, ODD_TEXTS, empty, frame, words


def brute_components(texts, width, similarity):
    sets = []
    for t in texts:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= similarity * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def families(seed, n_base, copies, most):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n_base):
        base = rng.choices(vocabulary, k=rng.choice([5, 12, 40, 150, 300]))
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(most)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
            if rng.random() < 0.4:
                base = copy  # copies of copies
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("width,similarity,seed", [(3, 90, 1), (3, 90, 2), (5, 80, 3), (3, 60, 4)])
def test_components_are_those_of_all_pairs(spark, width, similarity, seed):
    texts = ODD_TEXTS + families(seed, 6, 14, 9) + ["THREE Words here", "three words HERE"]
    docs = frame(spark, texts)
    got = jaccard.jaccard_components(docs, shared.shared_folder(spark), width, similarity)
    assert sorted(map(tuple, got.collect())) == brute_components(texts, width, similarity)


@pytest.mark.parametrize("similarity", [60, 80, 90])
def test_linked_sets_share_a_signature(similarity):
    rng = np.random.default_rng(similarity)
    for n in [1, 2, 5, 9, 10, 19, 20, 60, 180, 200, 240, 900]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            allowed = (100 - similarity) * 2 * len(a) // (100 + similarity)
            drop, add = rng.integers(0, allowed // 2 + 1), 0
            add = int(rng.integers(0, max(1, allowed - drop + 1)))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= similarity * (len(a) + len(b) - common):
                assert np.intersect1d(jaccard.signatures(a, similarity), jaccard.signatures(b, similarity)).size


def test_join_without_rows_links_or_broadcasts(spark, monkeypatch):
    assert jaccard.jaccard_components(empty(spark), shared.shared_folder(spark)).count() == 0
    assert {r.component_id for r in jaccard.jaccard_components(frame(spark, [None, "", "a b c d"]), shared.shared_folder(spark)).collect()} == {0, 1, 2}
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", -1)
    texts = families(9, 3, 8, 5)
    got = jaccard.jaccard_components(frame(spark, texts), shared.shared_folder(spark))
    assert sorted(map(tuple, got.collect())) == brute_components(texts, 3, 90)


def test_keep_one(spark):
    texts = ["a b c d e f g h i j", "a b c d e f g h i j", "other words are in this one", None, ""]
    docs = frame(spark, texts)
    kept = jaccard.keep_one(docs.unionByName(docs), shared.shared_folder(spark))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4] and kept.columns == docs.columns


def test_components_of_long_paths(spark):
    edges = spark.range(200).selectExpr("(id * 37) % 201 as a", "((id + 1) * 37) % 201 as b")
    got = jaccard.components(edges, shared.shared_folder(spark), "path").collect()
    assert len(got) == 200 and {r.root for r in got} == {0}


def test_passages(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(3000)]

    def text(n):
        return rng.choices(vocabulary, k=n)

    exact, fuzzy = text(60), text(120)
    changed = [w if rng.random() > 0.08 else "zz" for w in fuzzy]
    docs = [text(300) for _ in range(40)]
    docs[3][50:50] = exact
    docs[17][200:200] = exact
    docs[30][0:0] = exact
    docs[8][100:100] = fuzzy
    docs[25][20:20] = changed
    docs.append([*docs[12]])  # a copy
    docs[5][0:0] = docs[6][:30]  # too short
    found = passages.shared_passages(frame(spark, [" ".join(d) for d in docs] + [*ODD_TEXTS]), shared.shared_folder(spark)).collect()
    pairs = {frozenset((r.doc_id, r.partner_id)) for r in found if r.doc_id < 41}
    assert {r.doc_id for r in found if r.doc_id < 41} == {3, 17, 30, 8, 25, 12, 40}
    assert frozenset((8, 25)) in pairs and frozenset((12, 40)) in pairs
    spans = {r.doc_id: (r.start_word, r.end_word) for r in found}
    assert spans[3] == (50, 110) and spans[17] == (200, 260) and spans[30] == (0, 60) and spans[40] == (0, 300)
    assert spans[8][0] >= 98 and spans[8][1] <= 222 and spans[8][1] - spans[8][0] >= 100
    assert passages.shared_passages(empty(spark), shared.shared_folder(spark)).count() == 0


def exact_holders(docs, n=50):
    """Documents with n words that stand exactly so in another one, of all pairs."""
    runs = [{tuple(d[i : i + n]) for i in range(len(d) - n + 1)} for d in docs]
    return {a for a in range(len(docs)) if any(a != b and runs[a] & runs[b] for b in range(len(docs)))}


def test_exact_passages_whose_seeds_stand_in_earlier_documents(spark):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(20_000)]

    def text(n):
        return rng.choices(vocabulary, k=n)

    early, late = [], []
    for _ in range(4):
        passage = text(50)  # every seed has another first document
        early += [[*text(20), *passage[i : i + 16], *text(20)] for i in range(35)]
        late += [[*text(30), *passage, *text(20)], [*text(70), *passage, *text(10)]]
        passage = text(60)  # most seeds have one first document, too unlike to count
        early.append([*text(20), *passage[:20], *text(12), *passage[20:40], *text(12), *passage[40:], *text(20)])
        late += [[*text(30), *passage, *text(20)], [*text(70), *passage, *text(10)]]
        passage = text(50)  # every seed stands before the passage already, in another order
        pieces = [w for i in rng.sample(range(35), 35) for w in [*passage[i : i + 16], *text(3)]]
        other = [w for i in rng.sample(range(35), 35) for w in [*passage[i : i + 16], *text(3)]]
        late += [[*pieces, *text(30), *passage, *text(20)], [*text(70), *other, *passage]]
    docs = early + late
    want = exact_holders(docs)
    assert want == set(range(len(early), len(docs)))
    found = passages.shared_passages(frame(spark, [" ".join(d) for d in docs]), shared.shared_folder(spark)).collect()
    assert {r.doc_id for r in found} >= want


def test_seeds_of_shared_runs():
    rng = np.random.default_rng(2)
    for _ in range(50):
        run = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
        a, b = (np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64), run, rng.integers(0, 1 << 63, m, dtype=np.uint64)]) for n, m in ((30, 9), (5, 40)))
        assert set(a[passages.winnowed(a, 12)].tolist()) & set(b[passages.winnowed(b, 12)].tolist())
    assert passages.winnowed(np.zeros(0, np.uint64), 12).size == 0 and passages.winnowed(np.zeros(50, np.uint64), 12).size


def brute_chain(x, y, gain, cost):
    best = [gain] * len(x)
    order = sorted(range(len(x)), key=lambda i: (x[i], -y[i]))
    for n, i in enumerate(order):
        for j in order[:n]:
            if x[j] < x[i] and y[j] < y[i]:
                best[i] = max(best[i], gain + best[j] - cost * (x[i] - x[j] + y[i] - y[j]))
    return max(best)


def test_chains_are_best():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(1, 25))
        x, y = rng.integers(0, 40, n), rng.integers(0, 40, n)
        runs = passages.chain(x, y, 5.0, 0.2, 10_000)
        assert sorted(i for r in runs for i in r) == list(range(n))
        first = runs[0]
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(first, first[1:], strict=False))
        score = 5.0 * len(first) - 0.2 * (x[first[-1]] - x[first[0]] + y[first[-1]] - y[first[0]])
        assert score == pytest.approx(brute_chain(x.tolist(), y.tolist(), 5.0, 0.2))


def test_top_k_of_large_components(spark):
    """Squares beyond 64 bits, products within."""
    points = spark.createDataFrame([(0, [4 * 10**9, 1]), (1, [-(4 * 10**9), 3]), (2, [0, 5])], "vec_id long, x array<bigint>")
    queries = spark.createDataFrame([(9, [1, 2])], "vec_id long, x array<bigint>")
    rows = topk.exact_top_k(queries, points, shared.shared_folder(spark)).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(0, 4 * 10**9 + 2), (2, 10), (1, -4 * 10**9 + 6)]


def test_top_k(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.normal(size=8).round(1)]) for i in range(300)]
    rows += [(300, [1.0] * 8), (301, [1.0] * 8), (302, None), (303, [None] * 8), (304, [float("nan")] * 8), (305, [float("inf")] * 8), (306, []), (307, [0.5] * 3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id as x")
    made = topk.quantised(vectors, "vec_id", "embedding", 64.0)
    assert made.count() == 304
    got = topk.exact_top_k(made.where("vec_id % 20 = 0"), made, shared.shared_folder(spark), k=20, point_rows=64, query_rows=5)
    points = {r.vec_id: r.x for r in made.collect()}
    want = []
    for q in (i for i in points if i % 20 == 0):
        scored = sorted(((-sum(a * b for a, b in zip(points[q], x, strict=False)), i) for i, x in points.items() if i != q))[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    few = made.where("vec_id < 3")
    assert topk.exact_top_k(few, few, shared.shared_folder(spark)).count() == 6
    assert topk.exact_top_k(made.limit(0), made.limit(0), shared.shared_folder(spark)).count() == 0


def test_bounds_stop_early():
    rng = np.random.default_rng(1)
    centers = rng.integers(-60, 60, (10, 16))
    points = (centers[rng.integers(0, 10, 4000)] + rng.integers(-2, 3, (4000, 16))).astype(float)
    radius2 = float((points**2).sum(1).max())
    base = np.column_stack([points[:16], np.sqrt(radius2 - (points[:16] ** 2).sum(1))])
    evaluated = [e for *_, e in topk.search_block(points[:5], np.arange(5), points, np.arange(4000), radius2, base, 10, run=128)]
    assert evaluated[-1] < 5 * 4000 * 0.8


def test_keep_one_with_null_and_repeated_ids(spark):
    copy = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(7, copy + " end", 1), (7, other, 2), (None, copy, 3), (None, "words of its own that nobody else has", 4), (3, copy, 5), (None, other, 6), (9, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int").withColumnRenamed("_id", "_id").selectExpr("*", "_id as _print", "_id as _kept", "_id as component", "_id as n", "_id as vertex")
    kept = jaccard.keep_one(docs, shared.shared_folder(spark))
    assert sorted(r._id for r in kept.collect()) == [2, 4, 5, 7] and kept.columns == docs.columns
    found = jaccard.jaccard_components(docs, shared.shared_folder(spark), 5, 80).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in found) == [(-1, -1), (-1, 3), (-1, 7), (3, 3), (7, 3), (7, 7), (9, 9)]


@pytest.mark.parametrize("similarity,small,hot", [(80, 8, 64), (80, 1, 2), (90, 2, 3)])
def test_large_groups_and_hot_signatures(spark, monkeypatch, similarity, small, hot):
    for name, value in (("SMALL", small), ("HOT", hot), ("BLOCK_SIGNATURES", 4000), ("RANGE_SIGNATURES", 500), ("BLOCK_MEMBERS", 7)):
        monkeypatch.setattr(jaccard, name, value)
    texts = families(11, 3, 60, 12)
    got = jaccard.jaccard_components(frame(spark, texts), shared.shared_folder(spark), 5, similarity)
    assert sorted(map(tuple, got.collect())) == brute_components(texts, 5, similarity)


@pytest.mark.parametrize("rate", [0.0, 0.06])
def test_recall_of_passages_whose_parts_stand_elsewhere(spark, rate):
    """Two documents share 90 words, reworded in one; both halves and the middle also stand, too short to count, in others."""
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(5000)]
    say = lambda k: rng.choices(vocabulary, k=k)
    docs, want = [], set()
    for _ in range(60):
        passage = say(90)
        for part in (passage[:45], passage[45:], passage[22:67]):
            docs.append(say(30) + part + say(30))
        want |= {len(docs), len(docs) + 1}
        docs.append(say(40) + passage + say(20))
        docs.append(say(20) + [w if rng.random() > rate else "other" for w in passage] + say(40))
    found = passages.shared_passages(frame(spark, [" ".join(d) for d in docs]), shared.shared_folder(spark)).collect()
    got = {r.doc_id for r in found}
    assert got <= want  # half passages are too short
    assert len(got) >= (len(want) if rate == 0 else 0.95 * len(want)), len(got) / len(want)


def test_large_sets_are_told_apart_without_their_texts(spark):
    """A sketch of 2,048 bits allows any two sets of more than 4,608 elements at similarity 80."""
    rng = random.Random(31)
    vocabulary = [f"v{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=6000)) for _ in range(6)]
    near = rng.choices(vocabulary, k=4103)
    texts += [" ".join(near), " ".join([*near[:3995], "other", *near[4000:]])]  # wide sketches of different lengths
    docs = frame(spark, texts)
    made = jaccard.shingle_table(docs, 5).selectExpr("*", "n_shingles as n").cache()
    first = made.orderBy("doc_id").first().vertex
    stars = made.where(f"vertex <> {first}").selectExpr(f"{first}L as a", "vertex as b")
    none = made.limit(0).selectExpr("vertex as id", "vertex as root")
    ids = {r.vertex: r.doc_id for r in made.collect()}
    far = jaccard._far_pairs(stars, none, made, 80).collect()
    assert {frozenset((ids[r.a], ids[r.b])) for r in far} == {frozenset((6, 7))}
    pairs = made.alias("x").crossJoin(made.alias("y")).where("x.vertex < y.vertex").selectExpr("x.vertex as a", "y.vertex as b")
    assert {frozenset((ids[r.a], ids[r.b])) for r in jaccard._told_apart(pairs, made, 80).collect()} == {frozenset((6, 7))}
    got = jaccard.jaccard_components(docs, shared.shared_folder(spark), 5, 80)
    assert sorted(map(tuple, got.collect())) == brute_components(texts, 5, 80)


def test_wide_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(8)
    for n in (2049, 4096, 4097, 9000, 40_000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for gone, new in ((0, 0), (5, 300), (n // 8, n // 16), (n // 2, 0), (n, n)):
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)])
            x, y = jaccard.wide_sketch(a), jaccard.wide_sketch(b)
            if y is not None:
                assert jaccard.differing(x, y) == jaccard.differing(y, x) <= gone + new
        assert jaccard.differing(x, y) > (2 * n) * 20 / 180  # nothing in common: no link at 80
    assert jaccard.wide_sketch(a[:2048]) is None


def test_rows_are_winnowed_together_as_alone():
    rng = np.random.default_rng(3)
    for _ in range(100):
        lengths = rng.choice([0, 1, 4, 5, 6, 16, 17, 30, 49, 50, 80, 200], size=rng.integers(0, 12))
        first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        said = rng.integers(0, rng.choice([1, 3, 50, 1 << 62]), first[-1], dtype=np.uint64)
        for width, window in ((5, 12), (27, 24), (3, 1)):
            want = []
            for i in range(len(lengths)):
                hashes = shared.window_hashes(said[first[i] : first[i + 1]], width)
                want += [(i, int(at), int(hashes[at])) for at in passages.winnowed(hashes, window)]
            assert want == list(zip(*(c.tolist() for c in passages._winnowed_rows(said, first, width, window)), strict=True))


def test_reworded_passages_whose_seeds_others_lead_to(spark):
    """Two documents share a reworded passage whose seeds 24 others hold in pieces, so that no order need lead to the two."""
    rng = random.Random(41)
    vocabulary = [f"v{i}" for i in range(20_000)]
    say = lambda k: rng.choices(vocabulary, k=k)
    docs, want = [], set()
    for _ in range(12):
        passage = say(80)
        for _ in range(24):
            docs.append([w for i in range(0, 80, 20) for w in [*passage[i : i + 20], *say(60)]])
        want |= {len(docs), len(docs) + 1}
        other = [w if i % 20 or not i else "changed" for i, w in enumerate(passage)]  # no 50 words stand exactly so
        docs += [[*say(30), *passage, *say(30)], [*say(50), *other, *say(20)]]
    assert not exact_holders(docs)
    found = passages.shared_passages(frame(spark, [" ".join(d) for d in docs]), shared.shared_folder(spark)).collect()
    assert {r.doc_id for r in found} == want


def test_reworded_passages_at_two_places(spark):
    rng = random.Random(43)
    vocabulary = [f"v{i}" for i in range(20_000)]
    say = lambda k: rng.choices(vocabulary, k=k)
    changed = lambda words: [f"new{rng.random()}" if i % 19 == 9 else w for i, w in enumerate(words)]
    docs = []
    for _ in range(10):
        passage = say(90)
        docs += [[*say(40), *passage, *say(20)], [*changed(passage), *say(100), *changed(passage), *say(30)]]
    found = passages.shared_passages(frame(spark, [" ".join(d) for d in docs]), shared.shared_folder(spark)).collect()
    for b in range(1, 20, 2):
        assert any(r.doc_id == b and r.end_word <= 95 for r in found) and any(r.doc_id == b and 185 <= r.start_word for r in found)


def test_a_repeated_word_is_no_passage_from_each_of_its_places(spark):
    rng = random.Random(47)
    vocabulary = [f"v{i}" for i in range(20_000)]
    say = lambda k: rng.choices(vocabulary, k=k)
    docs = [[*say(40), *["same"] * 2000, *say(40)], [*say(30), *["same"] * 60, *say(30)], say(100)]
    found = passages.shared_passages(frame(spark, [" ".join(d) for d in docs]), shared.shared_folder(spark)).collect()
    for doc, low, high in ((0, 40, 2040), (1, 30, 90)):
        assert {w for r in found if r.doc_id == doc for w in range(r.start_word, r.end_word)} == set(range(low, high))
    assert {r.doc_id for r in found} == {0, 1} and len(found) <= 2 * 2000 // 50


def test_matches_are_chained_together_as_alone():
    rng = np.random.default_rng(13)
    for _ in range(60):
        groups, want = [], set()
        for p in range(int(rng.integers(0, 6))):
            n, size = int(rng.integers(1, 15)), int(rng.choice([8, 60, 500]))
            xy = rng.integers(0, size, (n, 2)) if rng.random() < 0.5 else np.cumsum(rng.integers(1, 45, (n, 2)), 0)
            xy = np.unique(xy, axis=0)
            groups.append(np.column_stack([np.full(len(xy), p // 2), np.full(len(xy), p), xy]))
            want |= {(p // 2, p, *map(tuple, xy[r].T.tolist())) for r in passages.chain(*xy.T, 5.0, 0.05, 40) if len(r) > 1}
        at, p, x, y = np.concatenate([*groups, np.zeros((0, 4), np.int64)]).T
        at, p, ends, x, y = passages._chained(at, p, x, y, 5.0, 0.05, 40)
        got = [(int(at[i]), int(p[i]), *(tuple(v[ends[i] : ends[i + 1]].tolist()) for v in (x, y))) for i in range(len(at))]
        assert len(got) == len(want) and set(got) == want


def test_common_words_are_those_of_the_table():
    rng = random.Random(17)
    for _ in range(300):
        a, b = (rng.choices(range(rng.choice([2, 6, 90])), k=rng.randrange(0, 70)) for _ in range(2))
        row = [0] * (len(b) + 1)
        for v in a:
            row = _next_row(row, v, b)
        assert passages._common(a, b) == row[-1]


def _next_row(row, value, other):
    new = [0]
    for j, w in enumerate(other, 1):
        new.append(row[j - 1] + 1 if value == w else max(row[j], new[-1]))
    return new


def test_seeds_beside_their_like_alone_are_left_out():
    row, place, seed = np.array([0, 0, 0, 0, 0, 1, 1, 2, 2]), np.array([0, 9, 20, 60, 61, 0, 1, 3, 44]), np.array([5, 7, 7, 7, 7, 7, 7, 1, 2])
    assert passages._beside_others(row, place, seed, 40).tolist() == [True, True, True, False, False, False, False, False, False]
    assert passages._beside_others(row[:0], place[:0], seed[:0], 40).tolist() == []


def test_reworded_passages_around_a_frequent_line(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    line, docs = word(30), []
    for i in range(170):
        if i < 20 and i % 2:  # the words around the line are those of the document before, every fourth changed
            docs.append(word(50) + [w if n % 4 else f"x{i}y{n}" for n, w in enumerate(before)] + line + [w if n % 4 != 3 else f"x{i}z{n}" for n, w in enumerate(after)] + word(50))
        else:
            before, after = word(15), word(15)
            docs.append(word(50) + before + line + after + word(50))
    for tile in (2000, 40):  # one tile, and many
        monkeypatch.setattr(passages, "TILE", tile)
        found = passages.shared_passages(frame(spark, [" ".join(d) for d in docs]), shared.shared_folder(spark)).collect()
        assert {(r.doc_id, r.partner_id) for r in found} >= {(i, i ^ 1) for i in range(20)}
        assert all(r.doc_id < 20 and r.partner_id == r.doc_id ^ 1 and abs(r.start_word - 50) < 3 and abs(r.end_word - 110) < 3 for r in found)


def test_many_extensions_are_those_of_each_pair():
    rng = np.random.default_rng(3)
    a = [rng.integers(0, 4, n).tolist() for n in rng.integers(0, 60, 60)]
    b = [[x if rng.random() > 0.2 else int(rng.integers(0, 4)) for x in v[int(rng.integers(0, 3)) :]] for v in a]

    def rows(lists, nothing):
        out = np.full((len(lists), 70), nothing)
        for i, v in enumerate(lists):
            out[i, : len(v)] = v
        return out, np.array([len(v) for v in lists])

    p, q = np.divmod(np.arange(3600), 60)
    got = passages._reach(*rows(a, -1), *rows(b, -2), p, q)
    assert [tuple(v) for v in got.T.tolist()] == [passages._extended(a[i], b[j], 6) for i, j in zip(p, q, strict=True)]
