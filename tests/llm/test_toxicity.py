"""The toxicity classifier: its n-grams against a plain version, and its accuracy on texts that it has not learned from."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from latewing.llm import shared, toxicity
from latewing.llm.toxicity import Grams, Settings
from tests.llm.helpers import ODD_TEXTS, empty, frame

SMALL = Settings(tasks=4)
SYLLABLES = ["ka", "lo", "mi", "ré", "tun", "sel", "ß", "or", "ench", "vi"]


def plain_grams(text, settings):
    """Every n-gram of code points that a space at most opens or closes."""
    out = set()
    words = (text or "").lower().split()
    joined = f" {' '.join(words)} " if words else ""
    for n in settings.orders:
        for i in range(len(joined) - n + 1):
            if " " not in joined[i + 1 : i + n - 1]:
                out.add(joined[i : i + n])
    return out


def _buckets(text, settings):
    pieces = list(Grams(settings).of(text))
    return set(np.concatenate(pieces).tolist()) if pieces else set()


def test_buckets_are_those_of_the_plain_n_grams():
    settings = Settings(bits=40)  # no collisions
    of_gram = {}
    for text in [t for t in ODD_TEXTS if len(t or "") < 6000]:
        for gram in plain_grams(text, settings):
            of_gram.setdefault(gram, None)
        assert len(_buckets(text, settings)) == len(plain_grams(text, settings))


def test_pieces_of_long_texts_lose_no_n_gram(monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(400))
    whole = _buckets(text, SMALL)
    for piece in (7, 50, 1000):
        monkeypatch.setattr(Grams, "PIECE", piece)
        assert _buckets(text, SMALL) == whole


def _prose(rng, n, marks=()):
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]
    for mark in marks:
        words.insert(rng.randrange(len(words) + 1), mark + rng.choice(SYLLABLES))
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(700):
        bad = rng.random() < 0.2
        rows.append((i, _prose(rng, rng.randint(20, 200), ["zwarg", "blixt"] if bad else [])))
        if i < 600:
            marks.append((i, int(bad)))
    rows += [(700, None), (701, ""), (702, rows[0][1]), (0, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame([(a, b, 1.5) for a, b in rows], "doc_id long, text string, Toxicity double")
    labels = spark.createDataFrame([*marks, (1, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    return docs, labels, {i: t for i, t in rows[:700]}


def test_unseen_texts_with_the_marks_are_found(spark, tables):
    docs, labels, texts = tables
    model = toxicity.learn(docs, labels.where(~toxicity.held_out()), shared.shared_folder(spark), SMALL)
    scored = toxicity.with_toxicity(docs, model)
    assert scored.columns.count("toxicity") == 1 and len(scored.columns) == 3  # the column of that name is replaced
    rows = scored.select("doc_id", "text", "toxicity.*").collect()
    assert len(rows) == 705
    unseen = [r for r in rows if r.doc_id is not None and r.doc_id < 700 and (r.doc_id >= 600 or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)]
    bad = [r for r in unseen if "zwarg" in r.text]
    assert len(bad) > 40
    assert np.mean([r.predicted for r in bad]) > 0.9
    assert np.mean([r.predicted for r in unseen if "zwarg" not in r.text]) < 0.02
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:  # copies and null ids score alike, null and empty texts too
        assert by_text.setdefault(r.text or "", r.score) == r.score


def test_labels_of_held_out_rows_change_nothing(spark, tables):
    docs, labels, _ = tables
    folder = shared.shared_folder(spark)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    models = [toxicity.learn(docs, t.where(~toxicity.held_out()), f"{folder}/{k}", SMALL) for k, t in enumerate((labels, turned))]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].bias == models[1].bias


def test_bound_on_rows_and_conflicting_labels(spark, tables):
    docs, labels, _ = tables
    few = Settings(tasks=4, most_rows=100)
    assert toxicity.labelled(labels, few).count() == 100
    assert toxicity.labelled(labels, SMALL).count() == 601  # all but the null ones; 9999 has no text
    conflicting = labels.union(spark.createDataFrame([(2, 0), (2, 1)], "doc_id long, toxic int"))
    assert 2 not in {r.id for r in toxicity.labelled(conflicting, SMALL).collect()}


@pytest.mark.parametrize("labels", [[], [(0, 1), (3, 1)], [(0, 0)]])
def test_too_few_labels_give_one_score_for_all(spark, labels):
    docs = frame(spark)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks, shared.shared_folder(spark), SMALL)
    rows = toxicity.with_toxicity(docs, model).collect()
    assert len(rows) == len(ODD_TEXTS) and len({r.toxicity.score for r in rows}) == 1


def test_empty_table(spark):
    model = toxicity.learn(empty(spark), spark.createDataFrame([(0, 1)], "doc_id long, toxic int"), shared.shared_folder(spark), SMALL)
    assert toxicity.with_toxicity(empty(spark), model).count() == 0


def test_query_reaches_its_accuracy_on_held_out_labels(spark):
    from latewing.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    got = QUERIES["op12_toxicity"](spark, folder)
    marks = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(marks, "doc_id").where("held_out").collect()
    assert got.count() == 1000
    bad = [r.predicted for r in rows if r.toxic]
    assert np.mean(bad) > 0.6 and np.mean([r.predicted for r in rows if not r.toxic]) < 0.02
