"""Token alignment against the definition: whole-text encodings, all overlapping pairs, counts over all texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from latewing.llm import alignment, shared
from latewing.llm.tokenizing import byte_alphabet
from tests.llm.helpers import ODD_TEXTS, empty, frame

A_PATH, B_PATH = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ALPHABET = [" ", " ", " ", "\n", "a", "the", "réeux", "'s", "1", "%", "\t", "日", "▁", "  ", "<s>", "<|endoftext|>", ".", "\x1c", "　", "é", "́", "😀", "\r", "<0x41>", "ing", "Word"]


@pytest.fixture(scope="module")
def plain():
    """Tokens of both sides as (id, bytes), straight from the libraries, or none."""
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    byte_of = {c: i for i, c in enumerate(byte_alphabet())}
    name_a = {i: bytes(byte_of.get(c, 0) for c in name) for name, i in a.get_vocab().items()}

    def tokens(text):
        if not text:
            return [], []
        whole = f" {text}".encode()
        left = [(i, name_a[i]) for i in a.encode(f" {text}", add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        if any(b"".join(x[1] for x in side) != whole for side in (left, right)):
            return [], []
        return left, right

    return tokens


def _intervals(tokens):
    out, at = [], 0
    for i, name in tokens:
        out.append((i, at, at + len(name)))
        at += len(name)
    return out


def expected(texts, tokens):
    rows, links, held = [], [], Counter()
    for text in texts:
        left, right = map(_intervals, tokens(text))
        shut = {x[2] for x in left} & {x[2] for x in right}
        groups, own = [], ([], [])
        for end, side, i in sorted([(x[2], 0, x[0]) for x in left] + [(x[2], 1, x[0]) for x in right]):
            own[side].append(i)
            if side and end in shut:
                groups.append("|".join(",".join(map(str, part)) for part in own))
                own = ([], [])
        linked, first = [], 0
        for i, lo, hi in left:  # all overlapping pairs; b tokens before ``first`` end too early for good
            while first < len(right) and right[first][2] <= lo:
                first += 1
            for j, low, high in right[first:]:
                if low >= hi:
                    break
                if high > lo:
                    linked.append((i, j))
        links.append(linked)
        held.update(set(linked))
        written = ";".join(groups)
        rows.append([len(left), len(right), len(groups), len(linked), hashlib.sha256(written.encode()).hexdigest() if left else ""])
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [(*r[:4], sum(held[x] == most[x[0]] for x in linked), sum(held[x] for x in linked), r[4]) for r, linked in zip(rows, links, strict=True)], held


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _same(spark, texts, tokens):
    want, held = expected(texts, tokens)
    got, counts = alignment.align(frame(spark, texts), shared.shared_folder(spark), A_PATH, B_PATH)
    assert got.columns == ["doc_id", *COLUMNS]
    rows = {r.doc_id: tuple(r[1:]) for r in got.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert rows[i] == want[i], repr(text)[:200]
    assert {(r.a_id, r.b_id): r.n for r in counts.collect()} == dict(held)


def test_units_are_encoded_like_whole_texts(plain):
    rng = random.Random(2)
    a, b = alignment._sides(A_PATH, B_PATH)
    for _ in range(4000):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(1, 16)))
        units = alignment.units_of(text)
        assert "".join(units) == f" {text}"
        left, right = plain(text)
        if left:
            assert a.encode(units)[0].tolist() == [i for i, _ in left], repr(text)
            assert b.encode(units)[0].tolist() == [i for i, _ in right], repr(text)


def test_odd_texts_and_copies(spark, plain):
    _same(spark, [*ODD_TEXTS, *ODD_TEXTS[3:9], " " * 3000, "\n" * 500, "<s> a </s>", "▁", "a▁b", "ﬁ Ⅷ", "0" * 700, "日本" * 400], plain)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_in_small_blocks(spark, plain, monkeypatch, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(300)]
    _same(spark, texts, plain)


def test_blocks_and_forgotten_units_change_nothing(plain, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(200)]
    monkeypatch.setattr(alignment, "UNIT_CAP", 50)
    aligner = alignment.Aligner(A_PATH, B_PATH)
    want, _ = expected(texts, plain)
    for at in range(0, len(texts), 7):
        rows, pairs, times = aligner.block(texts[at : at + 7])
        assert [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in rows] == [(*w[:4], w[6]) for w in want[at : at + 7]]
        assert sum(r["n_pairs"] for r in rows) == len(pairs) and times.sum() == sum(r["n_links"] for r in rows)
    aligner.close()


def test_null_keys_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), ("k", "a b"), ("k", None)], "doc_id string, text string")
    rows = alignment.align(docs, shared.shared_folder(spark), A_PATH, B_PATH)[0].collect()
    assert sorted((r.doc_id or "", r.n_a) for r in rows) == [("", 2), ("k", 0), ("k", 2)]
    assert [r.count_sum for r in rows if r.n_a] == [4, 4]
    got, counts = alignment.align(empty(spark), shared.shared_folder(spark), A_PATH, B_PATH)
    assert got.count() == 0 and counts.count() == 0


def test_query_on_whole_documents(spark, plain):
    from latewing.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want, _ = expected(list(texts.values()), plain)
    got = {r.doc_id: tuple(r[1:]) for r in QUERIES["op11_token_alignment"](spark, folder).collect()}
    assert got == dict(zip(texts, want, strict=True))
