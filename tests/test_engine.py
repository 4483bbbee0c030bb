from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from latewing import config
from latewing.api import Engine
from latewing.cli import parse, settings
from latewing.errors import ConfigError, EmptyQueryError, EncoderError, PageRangeError, RegistryError
from latewing.functions.texts import is_blank
from latewing.operators import answering, ingestion, linalg
from latewing.operators.encoding import CodebookEncoder, EncoderRegistry
from latewing.sources import files, store
from latewing.streaming import watch


@pytest.fixture()
def engine(spark, tmp_path):
    docs = tmp_path / "docs"
    (docs / "deep").mkdir(parents=True)
    (docs / "a.pdf").write_text("red green blue\fred red")
    (docs / "b.PDF").write_text("yellow pink")
    (docs / "copy.pdf").write_text("yellow pink")
    (docs / "deep" / "c.pdf").write_text("brown grey \f black")
    (docs / "note.txt").write_text("red")
    settings = config.Config(watch_folder=str(docs), store=str(tmp_path / "store"))
    book = np.random.default_rng(0).normal(size=(101, 16))
    return Engine(spark, settings, CodebookEncoder(book / np.linalg.norm(book, axis=1, keepdims=True)))


def test_ingest_search_change_and_delete(spark, engine):
    folder = engine.config.watch_folder
    assert engine.start() == {"done": 3, "failed": 0}
    rows = {r.file_path.removeprefix(folder + "/"): r for r in engine.documents().collect()}
    assert set(rows) == {"a.pdf", "b.PDF", "deep/c.pdf"} and rows["a.pdf"].num_pages == 2
    hits = engine.query("red green", 10).collect()
    assert len(hits) == 5 and hits[0].filename == "a.pdf" and hits[0].page_number == 1 and hits[0].total_pages == 2
    assert [h.score for h in hits] == sorted((h.score for h in hits), reverse=True)
    assert engine.query(" \t", 5).count() == 0 and engine.query("red", 0).count() == 0 and len(engine.query("red", 2).collect()) == 2
    with pytest.raises(EmptyQueryError):
        engine.query("")
    with pytest.raises(ValueError):
        engine.query("red", -1)
    assert engine.start() == {"done": 0, "failed": 0}
    with open(f"{folder}/a.pdf", "w") as f:
        f.write("white")
    assert engine.scan() == {"done": 1, "failed": 0}
    assert engine.query("red", 20).where("filename = 'a.pdf'").count() == 3  # both contents stay searchable
    assert engine.query("red", 20, latest_only=True).where("filename = 'a.pdf'").count() == 1
    import os

    os.remove(f"{folder}/a.pdf")
    engine.scan()
    assert engine.query("red", 20).where("filename = 'a.pdf'").count() == 0
    assert engine.remove(f"{folder}/b.PDF") and not engine.remove("nothing")
    assert tuple(engine.status().first()) == (1, 1)


def test_failures_are_recorded_and_retried(spark, engine):
    def render(path, content):
        if path.endswith("b.PDF") or path.endswith("copy.pdf"):
            raise ValueError("torn page")
        return [] if path.endswith("c.pdf") else ["text"]

    good, engine.render = engine.render, render
    assert engine.start() == {"done": 1, "failed": 2}
    errors = {r.error_message for r in engine.documents().where("status = 'failed'").collect()}
    assert errors == {"torn page", "PDF contains zero pages."}
    engine.render = good
    assert engine.scan() == {"done": 2, "failed": 0}


def test_stream_and_listing_changes(spark, engine, tmp_path):
    engine.registry.initialise()
    engine.store.initialise()
    engine.watch(str(tmp_path / "checkpoint")).awaitTermination()
    assert engine.status().first().indexed_documents == 2  # a watch does not descend, copies count once
    was = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 5)], "file_path string, modified int, length int")
    now = spark.createDataFrame([("a", 1, 5), ("b", 2, 6), ("d", 1, 0)], "file_path string, modified int, length int")
    assert sorted(map(tuple, watch.changes(was, now).collect())) == [("b", "modified"), ("c", "deleted"), ("d", "created")]
    assert [r.file_path for r in watch.settled(was, now).collect()] == ["a"]


def test_pages_are_found_once_after_removal_and_reingestion(spark, engine):
    folder = engine.config.watch_folder
    engine.start()
    assert engine.remove(f"{folder}/a.pdf")
    assert engine.query("red", 20).where("filename = 'a.pdf'").count() == 0
    assert engine.scan() == {"done": 1, "failed": 0}
    found = [(r.filename, r.page_number, r.total_pages) for r in engine.query("red", 20).collect() if r.filename == "a.pdf"]
    assert sorted(found) == [("a.pdf", 1, 2), ("a.pdf", 2, 2)]
    before, hits = engine.store.read().count(), engine.query("red", 20).collect()
    engine.compact()
    assert engine.store.read().count() == before - 2 and engine.query("red", 20).collect() == hits
    # an attempt that broke off behind the pages: processing, reset, again
    engine.registry.processing(engine.documents().where("file_path like '%a.pdf'").first().file_hash, f"{folder}/a.pdf")
    assert engine.start() == {"done": 1, "failed": 0}
    assert engine.query("red", 20).where("filename = 'a.pdf'").count() == 2


def test_watch_sees_new_changed_and_deleted_files(spark, engine, tmp_path):
    import os
    import time

    folder = engine.config.watch_folder
    engine.registry.initialise()
    engine.store.initialise()
    query = engine.watch(str(tmp_path / "polled"), every="1 second")

    def until(condition):
        end = time.time() + 120
        while not condition():
            assert query.isActive and time.time() < end, query.exception()
            time.sleep(1)

    paths = lambda: {os.path.basename(r.file_path) for r in engine.documents().where("status = 'done'").collect()}
    try:
        until(lambda: paths() == {"a.pdf", "b.PDF"})  # copies count once, folders below are not watched
        with open(f"{folder}/a.pdf", "w") as f:
            f.write("quite other words here")
        until(lambda: engine.query("quite other", 20).where("filename = 'a.pdf'").count() == 3)
        os.remove(f"{folder}/a.pdf")
        until(lambda: paths() == {"b.PDF"})
    finally:
        engine.stop()


def test_chunks_of_pages_and_single_pages(spark, engine, tmp_path):
    class Long(ingestion.TextPages):
        def pages(self, path, content, start, end, dpi):
            if dpi != 99 or end - start > 8:
                raise ValueError("asked for too much")
            return super().pages(path, content, start, end, dpi)

    engine.config = replace(engine.config, render_dpi=99)
    with open(f"{engine.config.watch_folder}/long.pdf", "w") as f:
        f.write("\f".join(f"page{i}" for i in range(1, 20)))
    engine.render = Long()
    assert engine.start() == {"done": 4, "failed": 0}
    path = f"{engine.config.watch_folder}/long.pdf"
    assert engine.registry.by_path(path).first().num_pages == 19
    assert engine.query("page19", 50).where("filename = 'long.pdf'").count() == 19
    assert engine.page(path, 19) == "page19"
    assert open(engine.save_page(path, 2, str(tmp_path / "two.txt"))).read() == "page2"
    for n in (0, 20):
        with pytest.raises(PageRangeError):
            engine.page(path, n)
    with pytest.raises(RegistryError):
        engine.page("/etc/passwd", 1)
    assert engine.about()["state"] == "running"


def test_image_parts():
    import base64

    png = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mP8z8BQDwAEhQGAhKmMIQAAAABJRU5ErkJggg==")
    part = answering.image_part(png)
    assert part["mime_type"] in ("image/png", "image/jpeg") and base64.b64decode(part["data"])
    with pytest.raises((ValueError, OSError)):
        answering.image_part(b"no image")


def test_projection(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, -1.0])]
    table = spark.createDataFrame(rows, "id int, vec array<float>")
    made = linalg.projected(table, np.array([[1.0, 1.0], [0.0, 2.0], [3.0, 0.0]]), np.array([0.5, 0.0, 0.0]))
    assert [r.projected for r in made.orderBy("id").collect()] == [[3.5, 4.0, 3.0], None, [-0.5, -2.0, 0.0]]
    assert linalg.projected(table.limit(0), np.ones((2, 2))).count() == 0
    with pytest.raises(Exception, match="wide"):
        linalg.projected(table, np.ones((2, 3))).collect()


def test_chunks_and_pages(spark):
    docs = spark.createDataFrame([(n,) for n in (0, 1, 8, 9, 16)], "num_pages int")
    got = sorted((r.num_pages, r.chunk_start, r.chunk_end) for r in store.page_chunks(docs).collect())
    assert got == [(1, 0, 1), (8, 0, 8), (9, 0, 8), (9, 8, 9), (16, 0, 8), (16, 8, 16)]
    pages = spark.createDataFrame([("a", 1), ("a", 2)], "file_path string, page_number int")
    assert store.one_page(pages, "a", 2).count() == 1
    for n in (0, 3):
        with pytest.raises(PageRangeError):
            store.one_page(pages, "a", n)


def test_npy(spark, tmp_path):
    np.save(tmp_path / "h1.npy", np.arange(12, dtype=np.float32).reshape(2, 3, 2))
    np.save(tmp_path / "h2.npy", np.arange(4, dtype=np.float32).reshape(2, 2))
    rows = files.npy_embeddings(spark, str(tmp_path)).orderBy("file_hash", "page_number").collect()
    assert [(r.file_hash, r.page_number, r.n_tokens, r.dim, np.frombuffer(r.flat, np.float32).tolist()) for r in rows] == [("h1", 1, 3, 2, [0, 1, 2, 3, 4, 5]), ("h1", 2, 3, 2, [6, 7, 8, 9, 10, 11]), ("h2", 1, 2, 2, [0, 1, 2, 3])]


def test_answers(spark):
    hits = spark.createDataFrame([(2.0, "/d/a.pdf", "a.pdf", 1), (1.0, "/d/b.pdf", "b.pdf", 3)], "score double, file_path string, filename string, page_number int")

    class Model:
        def __init__(self, said):
            self.said, self.labels = said, None

        def is_available(self):
            return True

        def generate(self, query, labels, images):
            self.labels = labels
            return self.said

    none = hits.limit(0)
    assert answering.query_and_answer("q", none, {}, Model("x"))["status"] == "no_results"
    assert answering.query_and_answer("q", hits, {}, answering.NoAnswerer())["status"] == "fallback_pages_only"
    assert answering.query_and_answer("q", hits, {}, Model("x"))["status"] == "fallback_pages_only"
    model = Model(" yes ")
    got = answering.query_and_answer("q", hits, {("/d/b.pdf", 3): b"png"}, model)
    assert got["status"] == "success" and got["answer"] == "yes" and model.labels == ["[Document Page 2 | File: b.pdf | Page: 3]"]
    assert answering.query_and_answer("q", hits, {("/d/b.pdf", 3): b"png"}, Model(None))["status"] == "fallback_pages_only"
    prompt = answering.prompts(hits.withColumn("g", F.lit(1)), F.lit("why?"), ["g"]).first().prompt
    assert prompt.endswith("[Document Page 1 | File: a.pdf | Page: 1]\n[Document Page 2 | File: b.pdf | Page: 3]\nQuestion: why?")


def test_configuration(tmp_path):
    with pytest.warns(UserWarning):
        assert config.load(tmp_path / "none.yaml") == config.Config()
    (tmp_path / "a.yaml").write_text("top_k: 7\nanswer_api_key: ' '\nother: 1\n")
    made = config.load(tmp_path / "a.yaml")
    assert made.top_k == 7 and made.answer_api_key is None and made.as_dict()["answer_api_key_configured"] is False
    for bad in ("a: [", "base_model_id: ''", "- 1"):
        (tmp_path / "b.yaml").write_text(bad)
        with pytest.raises(ConfigError):
            config.load(tmp_path / "b.yaml")


def test_command_line_and_encoders():
    assert parse([]).command == "server" and parse(["my.yaml"]).config == "my.yaml"
    assert parse(["query", "x", "--top-k", "2"]).top_k == 2 and parse(["query", "x"]).top_k is None
    with pytest.warns(UserWarning):
        assert settings(parse(["query", "x", "-c", "none.yaml"])).top_k == 3
        assert settings(parse(["server", "none.yaml", "--port", "81"])).port == 81
    registry = EncoderRegistry()
    with pytest.raises(EncoderError):
        registry.get_for_model("x")
    registry.register("c", CodebookEncoder)
    assert registry.get_for_model("my-CODEBOOK") is CodebookEncoder
    with pytest.warns(UserWarning):
        assert registry.get_for_model("other") is CodebookEncoder
    with pytest.raises(EncoderError):
        CodebookEncoder(np.ones((2, 2))).encode_texts([])
    assert is_blank(" \n") and not is_blank("x")
