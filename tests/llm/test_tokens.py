import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from latewing.llm import packing, shared, tokenfile
from latewing.llm.tokenizing import encoder
from tests.llm.helpers import ODD_TEXTS, empty, frame

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@lru_cache
def plain(name, special_as_text=False):
    """The library's own tokenizer, not the one under test."""
    tok = Tokenizer.from_file(tokenfile.default_vocabulary(name))
    if special_as_text:
        tok.encode_special_tokens = True
    return tok


def library(name, text):
    return plain(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_encoder_gives_what_the_library_gives(name):
    encode = encoder(tokenfile.default_vocabulary(name))
    for text in ODD_TEXTS + ["x\x85 y", "İstanbul ΣΑΣ", "a\u0301 e\u0301", "it's. 'shh' don't", "1,000.50 (x)-y", "a\u00adb", "\tx", "x \x1c y"]:
        assert encode.encode(text).tolist() == library(name, text), repr(text)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab Zé'st.,!1 2\n\t\u00a0\x85-%日σΣ<|>"), max_size=60))
def test_encoder_on_random_texts(name, text):
    assert encoder(tokenfile.default_vocabulary(name)).encode(text).tolist() == library(name, text)


SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext|", "<|", " ", "a", "it's", "x<|endoftext|>y", "\n", "\u2028", "1"]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(parts=st.lists(st.sampled_from(SPECIAL), max_size=8))
def test_special_tokens_in_texts(name, parts):
    text, path = "".join(parts), tokenfile.default_vocabulary(name)
    assert encoder(path).encode(text).tolist() == library(name, text)
    assert encoder(path, True).encode(text).tolist() == plain(name, True).encode(text, add_special_tokens=False).ids


def test_full_memory_is_emptied_not_wrong(monkeypatch):
    from latewing.llm import tokenizing

    monkeypatch.setattr(tokenizing, "UNIT_CAP", 8)
    monkeypatch.setattr(tokenizing, "PIECE_CAP", 4)
    small = tokenizing.Encoder(tokenfile.default_vocabulary(NAMES[0]))
    text = " ".join(f"word{i} other{i % 7}," for i in range(300))
    assert small.encode(text).tolist() == library(NAMES[0], text)


def test_token_files_round_trip(spark):
    docs = frame(spark).unionByName(frame(spark, ["repeated id"]))
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    manifest = tokenfile.write_token_files(docs, shared.shared_folder(spark), tokenfile.default_vocabulary(NAMES[0]), 2, files=3, frame_bytes=500)
    read = sorted(tokenfile.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in read] == [r[0] for r in rows]
    want = {(i, zlib.crc32(np.array(library(NAMES[0], t) + [2], "<u4").tobytes())) for i, t in rows}
    assert {(r.doc_id, r.ids_crc32) for r in read} == want
    start = 0
    for r in read:
        assert r.start == start
        start += r.n_tokens
    # one document alone, by its frame
    found = None
    for path in [r.path for r in manifest.collect()]:
        reader = tokenfile.open_file(path)
        asked = []
        inner = reader.frame
        reader.frame = lambda i, inner=inner, asked=asked: asked.append(i) or inner(i)
        if got := reader.document(5):
            found = got
            assert len(asked) < len(reader.entries) or len(reader.entries) == 1
    assert found[0].tolist() == library(NAMES[0], ODD_TEXTS[5]) + [2]


def test_damage_is_noticed_and_any_decoder_reads_a_frame(tmp_path):
    import zstandard

    path = tmp_path / "x.tok"
    with open(path, "wb") as out:
        writer = tokenfile.FrameWriter(out, 2, frame_bytes=8)
        for i in range(9):
            writer.add(i if i else None, np.arange(i, dtype=np.uint16))
        writer.close()
    raw = bytearray(path.read_bytes())
    reader = tokenfile.open_file(f"file://{path}")
    assert sum(len(reader.frame(i)[0]) for i in range(len(reader.entries))) == 9
    assert reader.document(0) == [] and reader.document(4)[0].tolist() == [0, 1, 2, 3] and reader.document(99) == []
    assert zstandard.ZstdDecompressor().decompressobj().decompress(bytes(raw))
    raw[int(reader.starts[1]) + 12] ^= 0xFF
    path.write_bytes(raw)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.open_file(f"file://{path}").frame(1)


def test_empty_tables(spark):
    manifest = tokenfile.write_token_files(empty(spark), shared.shared_folder(spark), tokenfile.default_vocabulary(NAMES[0]), 2)
    assert tokenfile.read_token_files(manifest).count() == 0
    assert packing.pack_documents(empty(spark), shared.shared_folder(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_two_fit_packs_all_without_overlap(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets = packing.best_two_fit(lengths, 64)
    for b in set(bins.tolist()):
        own = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist(), strict=True))
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 64


def test_best_two_fit_improves_on_greedy():
    # greedy: 6 + 3, gap 1; the 3 gives way to two 2s
    bins, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 0]


def test_packing_of_documents(spark):
    docs = frame(spark, ODD_TEXTS + [f"some words of document {i} " * (i % 40) for i in range(300)])
    docs = docs.unionByName(docs.limit(5))
    placed = packing.pack_documents(docs, shared.shared_folder(spark), with_ids=True, capacity=256)
    rows = placed.collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for i, t in texts:
        ids = library(NAMES[1], t) + [1]
        want += [(i, k, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = packing.packed_sequences(placed).collect()
    total = sum(r.length for r in rows)
    assert sum(len(s.ids) // 4 for s in sequences) == total == sum(s.n_tokens for s in sequences) and max(s.n_tokens for s in sequences) <= 256
    assert len(sequences) <= total / 256 + 3


def test_rounds_repack_what_groups_leave(spark):
    pieces = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "cast(id % 97 + 150 as bigint) as length")
    placed = packing.pack(pieces, shared.shared_folder(spark), 1000, group_rows=200)
    fills = placed.groupBy("sequence_id").sum("length").collect()
    total = sum(r[1] for r in fills)
    assert placed.count() == 3000 and max(r[1] for r in fills) <= 1000 and len(fills) <= total / 1000 * 1.03 + 1


def test_one_document_beside_null_and_negative_ids(spark):
    rows = [(None, f"null {i}") for i in range(30)] + [(i, f"text {i}") for i in range(-20, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as part", "text as path", "1 as print")
    manifest = tokenfile.write_token_files(docs, shared.shared_folder(spark), tokenfile.default_vocabulary(NAMES[0]), 2, files=2, frame_bytes=20)
    readers = [tokenfile.open_file(r.path) for r in manifest.orderBy("part").collect()]
    for i in (-20, -1, 0, 19):
        found = [ids.tolist() for r in readers for ids in r.document(i)]
        assert found == [library(NAMES[0], f"text {i}") + [2]]
    assert [r.doc_id for r in sorted(tokenfile.read_token_files(manifest).collect(), key=lambda r: r.start)] == [None] * 30 + list(range(-20, 20))


def test_packing_query_against_the_library(spark):
    """Every piece of every document, by ids of a tokenizer of its own; sequences gapless, and nearly as few as can be."""
    docs = frame(spark, [*ODD_TEXTS, "long words " * 5000, *[f"document {i} " * (i % 97 + 1) for i in range(600)]])
    docs = docs.unionByName(frame(spark, ["repeated row"] * 3))
    made = packing.pack_documents(docs, shared.shared_folder(spark)).collect()
    want = []
    for r in docs.collect():
        ids = library(NAMES[1], r.text) + [1]
        want += [(r.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(r[:5] for r in made) == sorted(want)
    by = {}
    for r in made:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r.length for r in made) // 4096) + 1
    again = packing.pack_documents(docs.repartition(7), shared.shared_folder(spark)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, made))


def test_packing_keeps_columns_of_any_name(spark):
    pieces = spark.range(50).selectExpr("id", "id % 7 + 1 as length", "'a' as _group", "id as sequence", "id as fill", "id as `dotted.name`", "id as offset")
    made = packing.pack(pieces, shared.shared_folder(spark), 16)
    assert made.columns == ["id", "length", "_group", "sequence", "fill", "dotted.name", "sequence_id", "offset"]
    assert all(r.id == r.sequence == r.fill == r["dotted.name"] for r in made.collect()) and made.count() == 50
