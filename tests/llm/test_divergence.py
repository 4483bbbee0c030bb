"""The divergence audit against the definition, term by term and pair by pair."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from latewing.llm import divergence, shared
from tests.llm.helpers import LOWER, ODD_TEXTS, empty, frame

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=3, top=200):
    """(lang, source, part, item, value, rank) by summing over all kept terms of every pair."""
    held, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        held[lang].update(set(terms))
        count[lang, source].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update({t: count[g][t] for t in kept})

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        own = {g: shares(count[g]) for g in groups if g[0] == lang}
        q = shares(whole)
        for g, p in own.items():
            pairs = [(h[1], sum((p[t] - r[t]) ** 2 // r[t] for t in kept)) for h, r in own.items() if h != g]
            terms = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if count[g][t] and p[t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                order = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(*g, part, item, value, k) for k, (item, value) in enumerate(order[: top if part == "term" else None], 1)}
    return out


def _result(spark, docs, **settings):
    got = divergence.audit(docs, shared.shared_folder(spark), **settings)
    assert [n for n, _ in got.dtypes] == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_plain_sums(spark, seed):
    rng = random.Random(seed)
    words = ["Alpha", "alpha", "béta", "ÉTÉ", "été", "x", "日本", "don't", "a1b", "__", "ß", "gamma", "delta😀"]
    rows = [
        (rng.choice([None, "", " ".join(rng.choices(words, rng.choices(range(1, 14), k=13), k=rng.randint(0, 60)))]) if rng.random() < 0.2 else " ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice([None, "", "a", "b", "c", "é"]))
        for _ in range(120)
    ]
    rows += rows[:5] + [(None, "fr", "lonely"), ("one two", "fr", "other"), ("zz zz zz", "it", "a")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "text string, lang string, source string, n int, total string")
    assert _result(spark, docs) == plain(rows)
    assert _result(spark, docs, least_docs=1, top=2) == plain(rows, 1, 2)


def test_odd_texts_and_a_hot_source(spark):
    rows = [(t, "en", f"s{i % 3}") for i, t in enumerate(ODD_TEXTS)] + [("same words again here", "en", "hot")] * 300
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert _result(spark, docs) == plain(rows)


def test_large_counts_stay_exact(spark):
    """A term of one source only, which has nearly all words: squares of a billion."""
    rows = [("big " * 5000, "en", "a")] * 4 + [("small tiny", "en", "b")] * 3 + [("", "en", "c")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert _result(spark, docs) == plain(rows)


def test_frame_with_clashing_names_and_empty_table(spark):
    docs = frame(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert _result(spark, docs.withColumnRenamed("size", "terms").withColumnRenamed("start", "term")) == plain(rows)
    assert _result(spark, empty(spark)) == set()


def test_counts_are_passed_on_in_parts(monkeypatch):
    """However early a task passes its counts on, their sums are those of all words."""
    texts = [t for t in ODD_TEXTS if t is not None] * 2
    whole = Counter(t for text in texts for t in TERM.findall(text.translate(LOWER)))
    rows = [pa.RecordBatch.from_arrays([pa.array([t]), pa.array(["en"]), pa.array(["s"])], names=["text", "lang", "source"]) for t in texts]
    for bound in (0, 10, 10**6):
        monkeypatch.setattr(divergence, "HELD_TERMS", bound)
        sums, docs = Counter(), Counter()
        for batch in divergence._counted(iter(rows)):
            for r in batch.to_pylist():
                sums[r["term"]] += r["n"]
                docs[r["term"]] += r["docs"]
        assert sums == whole
        assert docs == Counter(t for text in texts for t in set(TERM.findall(text.translate(LOWER))))
