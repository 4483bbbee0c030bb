"""The pipeline as a whole: every stage on all that its predecessor kept."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from latewing.llm import mixing, pii, quality, shared
from tests.llm.helpers import ODD_TEXTS, empty, frame, words
from tests.llm.test_pairs import brute_components


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(13)
    vocabulary = [f"w{i}ed" for i in range(900)]
    made = []
    for i in range(60):
        base = rng.choices(vocabulary, k=rng.randrange(40, 200))
        made.append(" ".join(base))
        if i % 4 == 0:
            made.append(" ".join(base))
        if i % 5 == 0:
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            made.append(" ".join(near))
        if i % 9 == 0:
            made.append("the same line again and again " * 60)
        if i % 7 == 0:
            made.append(" ".join(rng.choices(vocabulary, k=60)) + f" write to someone{i}@example.org or +49 30 1234567 now")
    return made + ODD_TEXTS


def run(spark, docs, upto):
    folder = shared.shared_folder(spark)
    out = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:upto]):
        out.append(shared.stored(stage(spark, out[-1], ""), folder, f"{i}-{name}"))
    return out


def test_stages_follow_brute_force(spark, texts):
    docs = frame(spark, texts)
    source, good, kept, clean, mixed, packed = run(spark, docs, 5)
    assert all(d.columns == docs.columns for d in (good, kept, clean, mixed))

    # quality: the base rule and the bands, text by text
    bands = quality.Bands()
    want = set()
    for i, t in enumerate(texts):
        w = words(t)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        if len(w) >= 20 and 100 * len(inside) <= 30 * len(w) and quality.compression_verdict((t or "").encode(), bands)[2]:
            want.add(i)
    rows = {r.doc_id: r.text for r in good.collect()}
    assert set(rows) == want and len(want) > 60

    # near copies: one of each component of all pairs, the smallest doc_id
    ids = sorted(rows)
    firsts = {ids[c] for _, _, c in brute_components([rows[i] for i in ids], 5, 80)}
    held = {r.doc_id: r.text for r in kept.collect()}
    assert set(held) == firsts and len(firsts) < len(ids)

    # personal data: every base match is gone, texts without candidates are as they were
    after = {r.doc_id: r.text for r in clean.collect()}
    assert set(after) == set(held)
    for i, t in after.items():
        assert not any(valid for *_, valid in pii.base_matches(t))
        assert t == held[i] or pii.candidates(held[i])
    assert any("[email]" in t and "[phone]" in t for t in after.values())

    # the mix: words of each source near its target, no document beyond twice its size
    sizes = {i: len(words(t)) for i, t in after.items()}
    of = {r.doc_id: r.source for r in clean.collect()}
    took = Counter()
    for r in mixed.collect():
        assert after[r.doc_id].startswith(r.text)
        took[r.doc_id] += len(words(r.text))
    assert all(took[i] <= 2 * sizes[i] for i in took)
    table = spark.createDataFrame([(i, of[i], n) for i, n in sizes.items()], "row_id long, source string, size long")
    for r in mixing.source_targets(table).collect():
        assert r.target - 1 <= sum(n for i, n in took.items() if of[i] == r.source) <= r.target + 1e-6

    # packing: every piece once, sequences without gaps
    pieces = packed.collect()
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces) and sorted({p.doc_id for p in pieces}) == sorted(took)
    for number in {p.sequence_id for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p.sequence_id == number), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096


def test_an_empty_table_passes_all_stages(spark):
    assert run(spark, empty(spark), 5)[-1].count() == 0


def test_run_reads_the_documents(spark):
    assert re.search("sequence_id", str(corpus_pipeline.run(spark, "/root/testdata/sf0.001").schema))
