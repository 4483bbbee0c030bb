"""Search over many pages and for many queries, and batched encoding."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest

from latewing.api import Engine
from latewing.config import Config
from latewing.errors import EncoderError
from latewing.operators import encoding, scoring, search
from latewing.operators.encoding import CodebookEncoder, CodebookModel, Head, encoded


def _table(spark, pages):
    rows = [(f"f{i // 3}", i % 3 + 1, len(p), p.shape[1], np.asarray(p, np.float32).tobytes()) for i, p in enumerate(pages)]
    return spark.createDataFrame(rows, "file_hash string, page_number int, n_tokens int, dim int, flat binary")


KEYS = ["file_hash", "page_number"]


def _clusters(rng, n, dim):
    centres = rng.normal(size=(12, dim)) * 4
    return [centres[i % 12] + rng.normal(size=(rng.integers(1, 6), dim)) * 0.3 for i in range(n)]


@pytest.mark.parametrize("kind", ["clusters", "noise", "odd"])
def test_pages_in_bound_order_give_the_same_best(spark, kind):
    rng = np.random.default_rng(7)
    pages = _clusters(rng, 300, 8) if kind == "clusters" else [rng.normal(size=(rng.integers(1, 6), 8)) for _ in range(300)]
    if kind == "odd":
        pages[5] = np.zeros((0, 8))
        pages[6] = np.full((2, 8), np.nan)
        pages[7] = np.vstack([pages[7], np.full((1, 8), np.inf)])
        pages[20:30] = [pages[20]] * 10  # ties
    table = _table(spark, pages)
    query = pages[40][:1] + rng.normal(size=(3, 8)) * 0.1
    every = {(r.file_hash, r.page_number): r.score for r in scoring.score_packed(table, query, KEYS).collect()}
    envelopes = search.enveloped(table, KEYS)
    bounds = {(r.file_hash, r.page_number): r.bound for r in search.bounded(envelopes, query, KEYS).collect()}
    assert bounds.keys() == every.keys() and all(every[k] <= bounds[k] or np.isnan(every[k]) for k in every)
    for top_k in (1, 10, 400):
        found, said = search.best_pages(table, envelopes, query, KEYS, top_k, [], first=1, growth=2)
        got = {(r.file_hash, r.page_number): r.score for r in found.collect()}
        least = sorted(every.values(), reverse=True)[min(top_k, len(every)) - 1]
        assert {k for k, v in every.items() if v >= least} <= set(got) and said == {"pages": 300, "scored": len(got)}
        if kind == "clusters" and top_k == 1:
            assert said["scored"] < 100  # most clusters are out of reach
    none, said = search.best_pages(table.limit(0), envelopes.limit(0), query, KEYS, 3, [])
    assert none.count() == 0 and said == {"pages": 0, "scored": 0}


def test_many_queries_with_one_scan_are_single_queries(spark):
    rng = np.random.default_rng(1)
    pages = _table(spark, [rng.normal(size=(rng.integers(0, 5), 4)) for _ in range(60)])
    registry = spark.createDataFrame(
        [(f"f{i}", f"/d/{i}.pdf", "failed" if i % 7 == 3 else "done", "s" if i % 5 else "", 19 - i) for i in range(20)], "file_hash string, file_path string, status string, embedding_path string, ingest_seq long"
    )
    vectors = {f"q{i}": rng.normal(size=(i, 4)).astype(np.float32) for i in range(5)}
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()], "query_id string, query_vectors array<array<float>>")
    for top_k in (0, 1, 7, 100):
        made = search.search_many(queries, registry, pages, top_k)
        got = {}
        for r in made.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((round(r.score, 4), r.file_path, r.page_number, r.total_pages))
        for name, q in vectors.items():
            want = search.rank_hits(registry, scoring.score_packed(pages, q.reshape(-1, 4), KEYS), pages, top_k).collect()
            assert got.get(name, []) == [(round(r.score, 4), r.file_path, r.page_number, r.total_pages) for r in want], (name, top_k)
    plan = search.search_many(queries, registry, pages, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # all queries in one pass over the pages


@pytest.fixture()
def engine(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for name, text in (("a", "red green\fblue"), ("b", "yellow"), ("c", "pink red")):
        (docs / f"{name}.pdf").write_text(text)
    book = np.random.default_rng(0).normal(size=(101, 16))
    return Engine(spark, Config(watch_folder=str(docs), store=str(tmp_path / "store")), CodebookEncoder(book / np.linalg.norm(book, axis=1, keepdims=True)))


def test_requests_are_answered_as_they_come(spark, engine, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    requests = [
        {"request_id": "1", "query": "red green", "top_k": 2}, {"request_id": "2", "query": "red green"}, {"request_id": "3", "query": ""}, {"request_id": "4", "query": " \t"},
        {"request_id": "5", "query": "pink", "top_k": -1}, {"request_id": "6", "query": "pink", "top_k": 0}, {"request_id": "7", "query": None}, {"request_id": "8", "query": "pink", "top_k": 1000},
    ]
    (asked / "one.json").write_text("\n".join(map(json.dumps, requests)))
    engine.registry.initialise()
    engine.store.initialise()
    run = lambda: engine.serve(str(asked), str(tmp_path / "answers"), str(tmp_path / "served")).awaitTermination()
    run()
    read = lambda n: {r.request_id: r for r in spark.read.schema(search.ANSWERED).json(f"{tmp_path}/answers/{n}").collect()}
    assert {k: r.outcome for k, r in read(0).items()} == {"1": "no_results", "2": "no_results", "3": "error", "4": "no_results", "5": "error", "6": "no_results", "7": "error", "8": "error"}
    engine.start()
    (asked / "two.json").write_text("\n".join(map(json.dumps, requests)))
    run()
    got = read(1)
    assert sorted(os.listdir(tmp_path / "answers")) == ["0", "1"]
    for i, top_k in (("1", 2), ("2", 5)):
        want = engine.query("red green", top_k).collect()
        assert got[i].outcome == "success" and [(h.file_path, h.page_number, h.total_pages) for h in got[i].hits] == [(w.file_path, w.page_number, w.total_pages) for w in want]
        assert [h.score for h in got[i].hits] == pytest.approx([w.score for w in want], abs=1e-5)
    assert got["3"].error == got["7"].error == "the query is empty" and "top_k" in got["5"].error and "1000" in got["8"].error and not got["6"].hits


def test_models_see_small_batches_and_are_loaded_once(spark, tmp_path):
    class Counting:
        dim = 3

        def __init__(self, log):
            self.log = log

        def load(self):
            with open(self.log, "a") as f:
                f.write("load\n")

            def run(contents):
                with open(self.log, "a") as f:
                    f.write(f"{len(contents)}\n")
                return [np.arange(3 * len(c or "")).reshape(-1, 3) for c in contents]

            return run

    pages = spark.createDataFrame([("h", i, "x" * (i % 4) if i else None) for i in range(11)], "file_hash string, page_number int, content string").coalesce(1)
    head = Head(np.array([[1.0, 0, 0], [0, 2.0, 0]]), np.array([0.0, 1.0]), lambda cs: [np.arange(len(c or "")) % 2 for c in cs], True)
    rows = encoded(pages, Counting(str(tmp_path / "log")), head, batch=4).orderBy("page_number").collect()
    seen = (tmp_path / "log").read_text().split()
    assert seen.count("load") == 1 and sorted(x for x in seen if x != "load") == ["3", "4", "4"]
    assert [r.n_tokens for r in rows] == [i % 4 if i else 0 for i in range(11)] and {r.dim for r in rows} == {2}
    made = np.frombuffer(rows[3].flat, "<f4").reshape(3, 2)
    want = np.array([[0, 1], [3, 9], [6, 15.0]])
    assert np.allclose(made, want / np.linalg.norm(want, axis=1, keepdims=True) * [[0], [1], [0]])


    class Wrong:
        dim = 2

        def load(self):
            return lambda contents: [np.ones((1, 3))] * len(contents)

    with pytest.raises(Exception, match="width 2"):
        encoded(pages, Wrong()).collect()


def test_codebook_pages_without_a_shuffle(spark):
    book = np.random.default_rng(3).normal(size=(7, 4)).astype(np.float32)
    pages = spark.createDataFrame([("a", 1, " two words "), ("a", 2, ""), ("b", 1, None)], "file_hash string, page_number int, content string")
    made = CodebookEncoder(book).encode_pages(pages)
    rows = {(r.file_hash, r.page_number): r for r in made.collect()}
    assert np.array_equal(np.frombuffer(rows["a", 1].flat, "<f4").reshape(2, 4), CodebookEncoder(book).encode_texts(["two words"])[0])
    assert rows["a", 2].n_tokens == rows["b", 1].n_tokens == 0
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    back = {(r.file_hash, r.page_number): r.vectors for r in encoding.unpacked(made).collect()}
    assert len(back["a", 1]) == 2 and back["b", 1] == []
    assert CodebookModel(book).dim == 4
    with pytest.raises(EncoderError):
        CodebookEncoder(np.zeros((0, 3)))
