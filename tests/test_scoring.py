import numpy as np
import pytest
from pyspark.sql import functions as F

from latewing.errors import DimensionError
from latewing.functions import vectors as V
from latewing.operators import linalg, scoring
from latewing.plans import catalogue


def brute(q, d):
    if not len(q) or not len(d) or not len(q[0]):
        return 0.0
    s = np.array(q, float) @ np.array(d, float).T
    s = np.where(np.isnan(s), -np.inf, s)
    return float(s.max(1).sum())


def grid(n, dim, f):
    return [[f(i * dim + j) for j in range(dim)] for i in range(n)]


CASES = [
    ("single token", [[1, 2, 3, 4]], [[1, 1, 1, 1]], 10),
    ("two tokens", [[1, 0, 0, 0], [0, 1, 0, 0]], [[1, 0, 0, 0], [0, 1, 0, 0], [0.5, 0.5, 0, 0]], 2),
    ("orthogonal", [[1, 0], [0, 1]], [[1, 0], [0, 1]], 2),
    ("zeros", [[0] * 8] * 4, [[0] * 8] * 6, 0),
    ("negative best", [[-1, 2, -3, 4]], [[1, -2, 3, -4]], -30),
    ("odd width", [[1, 2, 3]], [[4, 5, 6]], 32),
    ("longer page", [[1, 0]], [[0, 1], [1, 0], [0.5, 0.5]], 1),
    ("longer query", [[1, 0], [0, 1], [0.5, 0.5]], [[1, 0]], 1.5),
    ("empty page", [[1, 0]], [], 0),
    ("empty query", [], [[1, 0]], 0),
    ("a zero vector beats negatives", [[1.0, 0.0]], [[-1, 0], [0, 0]], 0),
    ("nan never wins", [[1, 1]], [[float("nan"), 1], [2, 1]], 3),
    ("all nan", [[1, 1]], [[float("nan"), 1]], float("-inf")),
    ("width 128", grid(10, 128, lambda x: (x % 17 - 8) * 0.1), grid(25, 128, lambda x: (x % 19 - 9) * 0.1), 46.39),
] + [
    (f"width {d}", grid(5, d, lambda x: (x % 13 - 6) * 0.1), grid(12, d, lambda x: (x % 11 - 5) * 0.1), v)
    for d, v in [(1, 1.0), (7, 3.88), (8, 4.72), (15, 7.39), (16, 7.13), (64, 3.21), (130, 2.45)]
]


@pytest.mark.parametrize("name,q,d,expected", CASES, ids=[c[0] for c in CASES])
def test_known_scores(spark, name, q, d, expected):
    flat = [float(x) for v in d for x in v]
    pages = spark.createDataFrame([(1, [[float(x) for x in v] for v in d], flat)], "page int, vectors array<array<float>>, flat array<float>")
    assert scoring.score_pages(pages, q).first().score == pytest.approx(expected, abs=2e-4)
    width = len(q[0]) if q else 2
    got = scoring.score_packed(pages, np.array(q, np.float32).reshape(len(q), width), ["page"]).first().score
    assert got == pytest.approx(expected, abs=2e-3)
    assert brute(q, d) == pytest.approx(expected, abs=1e-2)


def test_forms_agree_on_ragged_pages_and_keep_empty_ones(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i, n in enumerate([3, 0, 1, 9, 0, 4]):
        d = rng.normal(size=(n, 6)).astype(np.float32)
        rows.append((i, d.tolist(), d.ravel().tolist()))
    q = rng.normal(size=(5, 6)).astype(np.float32)
    pages = spark.createDataFrame(rows, "page int, vectors array<array<float>>, flat array<float>")
    plan = {r.page: r.score for r in scoring.score_pages(pages, q.tolist()).collect()}
    kernel = {r.page: r.score for r in scoring.score_packed(pages, q, ["page"]).collect()}
    packed = scoring.packed_bytes(pages.select("page", "flat"))
    assert {r.page: r.score for r in scoring.score_packed(packed, q, ["page"]).collect()} == pytest.approx(kernel, abs=1e-5)
    assert scoring.score_packed(packed.withColumn("flat", F.lit(None).cast("binary")), q, ["page"]).agg(F.sum("score")).first()[0] == 0
    assert set(plan) == set(kernel) == set(range(6))
    for i, d, _ in rows:
        assert plan[i] == pytest.approx(kernel[i], abs=1e-4) == pytest.approx(brute(q, d), abs=1e-4)


def test_width_mismatch_is_an_error(spark):
    pages = spark.createDataFrame([(1, [[1.0, 2.0, 3.0]], [1.0, 2.0, 3.0])], "page int, vectors array<array<float>>, flat array<float>")
    with pytest.raises(Exception, match="differ in width"):
        scoring.score_pages(pages, [[1.0, 2.0]]).collect()
    with pytest.raises(Exception, match="no multiple"):
        scoring.score_packed(pages, [[1.0, 2.0]], ["page"]).collect()
    with pytest.raises(DimensionError):
        scoring.score_packed(pages, [1.0, 2.0], ["page"])


def test_tiles_and_ragged_batches(spark):
    flat = [x % 11 - 5.5 for x in range(5 * 16 * 32)] + [1.0] * 7  # a remainder is dropped
    q = grid(4, 32, lambda x: x % 7 - 3.5)
    batch = spark.createDataFrame([(flat,)], "flat array<float>")
    tiles = scoring.score_pages(scoring.split_tiles(batch, 32, 16), q).collect()
    assert sorted((r.tile, round(r.score, 3)) for r in tiles) == [(i, 189.5) for i in range(5)]
    ragged = spark.createDataFrame([([float(i) for i in range(20)], [3, 0, 2])], "flat array<float>, doc_lengths array<int>")
    got = scoring.split_ragged(ragged, 2).orderBy("doc_idx").collect()
    assert [r.vectors for r in got] == [[[0, 1], [2, 3], [4, 5]], [], [[6, 7], [8, 9]]]
    none = spark.createDataFrame([([], [])], "flat array<float>, doc_lengths array<int>")
    assert scoring.split_ragged(none, 2).count() == 0


@pytest.mark.parametrize("values,expected", [([], -np.inf), ([42], 42), ([-3.14], -3.14), ([1, np.inf, 2], np.inf), ([np.nan, 1, 2], 2), ([-np.inf] * 50, -np.inf), ([np.nan], -np.inf), (list(range(100, 0, -1)), 100)])
def test_vector_max(spark, values, expected):
    df = spark.createDataFrame([([float(v) for v in values],)], "v array<double>")
    assert df.select(V.vector_max(F.col("v"))).first()[0] == expected


@pytest.mark.parametrize("m,n,k,alpha,beta,ta,tb", [(5, 4, 3, 1, 0, False, False), (5, 4, 3, 0.5, 0.5, False, True), (5, 4, 3, 1, 1, True, False), (3, 3, 3, 0, 1, False, False), (3, 4, 2, 2, 3, True, True)])
def test_gemm(spark, m, n, k, alpha, beta, ta, tb):
    rng = np.random.default_rng(1)
    a, b, c = rng.normal(size=(m, k)), rng.normal(size=(k, n)), rng.normal(size=(m, n))

    def cells(x):
        return spark.createDataFrame([(i, j, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])], "i int, j int, v double")

    want = alpha * a @ b + beta * c
    for product in (linalg.gemm, linalg.gemm_cells):
        got = product(cells(a.T if ta else a), cells(b.T if tb else b), cells(c), alpha, beta, ta, tb).collect()
        assert len(got) == m * n and all(r.v == pytest.approx(want[r.i, r.j], abs=1e-9) for r in got)


@pytest.mark.parametrize("sent", [1 << 30, 0])
def test_gemm_of_many_tiles(spark, monkeypatch, sent):
    """Sparse matrices over several tiles, with infinities and cells that stand twice: as cell by cell."""
    monkeypatch.setattr(linalg, "SENT_BYTES", sent)
    rng = np.random.default_rng(5)

    def some(rows, columns, n, odd=()):
        made = [(int(rng.integers(rows)), int(rng.integers(columns)), float(rng.normal())) for _ in range(n)]
        return spark.createDataFrame([*made, *[(0, 3, x) for x in odd]], "i int, j int, v double")

    a, b, c = some(40, 30, 300), some(30, 25, 200, [float("inf")]), some(40, 25, 60)
    rows = lambda df: {(r.i, r.j): r.v for r in df.collect()}
    once = lambda df: df.groupBy("i", "j").agg(F.sum("v").alias("v"))
    got, want = rows(linalg.gemm(a, b, once(c), 0.5, 2.0, tile=8)), rows(linalg.gemm_cells(once(a), once(b), once(c), 0.5, 2.0))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9, nan_ok=True) for k in got)
    assert rows(linalg.gemm(a.limit(0), b, tile=8)) == {} and rows(linalg.gemm(a, b.limit(0), c, 1.0, 1.0, tile=8)) == pytest.approx(rows(once(c)))
    plan = linalg.gemm(a, b, tile=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_normalise_and_masks(spark):
    df = spark.createDataFrame([([3.0, 4.0], 1, 7), ([0.0, 0.0], 0, 8)], "v array<float>, m int, t int")
    got = df.select(V.l2_normalize(F.col("v")).alias("n"), V.masked(F.col("v"), F.col("m")).alias("m"), V.only_tokens(F.col("v"), F.col("t"), 7).alias("k")).collect()
    assert [list(r) for r in got] == [[[0.6, 0.8], [3, 4], [3, 4]], [[0, 0], [0, 0], [0, 0]]]


def test_score_matrix_does_not_depend_on_parts(spark, monkeypatch):
    queries = spark.createDataFrame([(i, [[float(i), 1.0]]) for i in range(7)], "query_id int, query_vectors array<array<double>>")
    pages = spark.createDataFrame([(i, [[1.0, float(i)]]) for i in range(4)], "page int, vectors array<array<double>>")
    whole = sorted(map(tuple, scoring.score_matrix(queries, pages).select("query_id", "page", "score").collect()))
    monkeypatch.setattr(scoring, "QUERY_BYTES", 20)
    assert sorted(map(tuple, scoring.score_matrix(queries, pages).select("query_id", "page", "score").collect())) == whole
    assert len(whole) == 28
    packed = pages.select("page", F.flatten("vectors").cast("array<float>").alias("flat"))
    for size in (1 << 20, 20):
        monkeypatch.setattr(scoring, "QUERY_BYTES", size)
        for form in (packed, scoring.packed_bytes(packed)):
            assert sorted(map(tuple, scoring.score_matrix_packed(queries, form, ["page"], rows=3).select("query_id", "page", "score").collect())) == whole


def test_score_matrix_by_tiles_on_ragged_pages(spark):
    rng = np.random.default_rng(2)
    qs = [rng.normal(size=(n, 3)) for n in (2, 0, 4)]
    ds = [rng.normal(size=(n, 3)) for n in (1, 0, 5, 3)]
    queries = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(qs)], "query_id int, query_vectors array<array<double>>")
    pages = spark.createDataFrame([(f"p{i}", i, d.ravel().tolist()) for i, d in enumerate(ds)] + [("none", 9, None)], "name string, page int, flat array<float>")
    got = {(r.query_id, r.name, r.page): r.score for r in scoring.score_matrix_packed(queries, pages, ["name", "page"]).collect()}
    want = {(i, f"p{j}", j): brute(q, d) for i, q in enumerate(qs) for j, d in enumerate(ds)} | {(i, "none", 9): 0.0 for i in range(3)}
    assert got == pytest.approx(want, abs=1e-4)
    assert scoring.score_matrix_packed(queries.limit(0), pages, ["page"]).count() == 0
    with pytest.raises(Exception, match="no multiple"):
        scoring.score_matrix_packed(queries, pages.withColumn("flat", F.array(F.lit(1.0)).cast("array<float>")), ["page"]).collect()


def test_scores_of_tokens_gather_no_page(spark):
    nan = float("nan")
    rows = [(i % 3, [float(i % 7), float(-i % 5)]) for i in range(40)] + [(3, [nan, nan]), (0, [nan, 1.0])]
    tokens = spark.createDataFrame(rows, "label long, vec array<float>")
    assert scoring.score_tokens(tokens.withColumnsRenamed({"label": "m0", "vec": "sims"}), [[1.0, 0.5]], ["m0"], "sims").count() == 4
    query = [[1.0, 0.5], [-1.0, 2.0]]
    got = scoring.score_tokens(tokens, query, ["label"])
    want = scoring.score_pages(scoring.pack_pages(tokens, ["label"]), query).select("label", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.score for r in scoring.score_tokens(tokens, [], ["label"]).collect()} == {0.0}
    plan = catalogue.QUERIES["maxsim_ragged"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_tiles_of_narrow_matrices_take_no_more_than_their_cells(spark):
    narrow = spark.range(600).selectExpr("cast(id as int) as i", "cast(id % 3 as int) as j", "cast(id as double) as v")
    made = linalg.tiles(narrow).collect()
    assert sorted((r.bi, len(r.cells)) for r in made) == [(0, 256 * 3 * 8), (1, 256 * 3 * 8), (2, 88 * 3 * 8)]
    wide = spark.range(500).selectExpr("cast(id % 2 as int) as i", "cast(id as int) as j", "1.5D as v")  # rows 0 and 1 of the three
    old = spark.createDataFrame([(599, 3, 2.0), (700, 700, 4.0)], "i int, j int, v double")
    want = {(r.i, r.j): r.v for r in linalg.gemm_cells(narrow, wide, old, 2.0, 0.5).collect()}
    assert {(r.i, r.j): r.v for r in linalg.gemm(narrow, wide, old, 2.0, 0.5).collect()} == want
