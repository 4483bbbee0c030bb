"""Folders, PDF files and file sinks."""

from __future__ import annotations

import hashlib
import io
import os
import pickle
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latewing.api import Engine
from latewing.config import Config
from latewing.operators import ingestion
from latewing.operators.encoding import CodebookEncoder
from latewing.session import ship
from latewing.sources import files, folders, pdf, sink
from latewing.streaming import watch

PAGES = ["hello (world) \\ é 日本 😀\nsecond line", "", "third ß page"]


def _open(data):
    return pdf.Pdf(io.BytesIO(data))


# PDF files


def test_fonts_and_digits_are_read_as_before():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0041> <0061> endbfchar"
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /F /ToUnicode 6 0 R >>"
    objects = _page(b"BT /F1 9 Tf <0041 004\n1 ZZ 0042 0041> Tj 0 -9 Td <0041004> Tj ET", font)
    objects[6] = b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream"
    document = _open(_plain(objects))
    assert document.text(0) == "aaa\na" == document.text(0) and len(document.fonts) == 1


@pytest.mark.parametrize("packed", [True, False])
def test_written_pages_are_read(packed):
    for pages in (PAGES, ["one"], [f"page {i}\nof many" for i in range(300)]):
        document = _open(pdf.written(pages, packed))
        assert len(document) == len(pages) and [document.text(i) for i in range(len(pages))] == pages


def _plain(objects, root=1, extra=""):
    """A file of objects in the open, with a table."""
    out, at = bytearray(b"%PDF-1.4\n"), {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start, last = len(out), max(objects)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (last + 1)
    for n in range(1, last + 1):
        out += b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 00000 f \n"
    return bytes(out + f"trailer << /Size {last + 1} /Root {root} 0 R {extra} >>\nstartxref\n{start}\n%%EOF".encode())


def _page(content, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", filters=b""):
    return {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>", 4: b"<< /Length %d %s >>\nstream\n" % (len(content), filters) + content + b"\nendstream", 5: font,
    }


def test_text_operators_and_encodings():
    content = (
        b"BT /F1 12 Tf 14 TL 72 700 Td (Hello \\(a\\) \\101\\\nB) Tj T* [(spa) -20 (ce) -300 (gap)] TJ 0 -14 Td <48 69> Tj 50 0 Td (right) Tj (next) ' ET "
        b"BI /W 1 ID \x00(no)\xff EI BT 1 0 0 1 72 10 Tm (end\x80) Tj ET"
    )
    assert _open(_plain(_page(content))).text(0) == "Hello (a) AB\nspace gap\nHi right\nnext\nend€"
    named = b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /B /quotedblleft /uni20AC 70 /nonsense] >> >>"
    assert _open(_plain(_page(b"BT /F1 1 Tf (ABCF) Tj ET", named))).text(0) == "B“€F"
    for name, packed in ((b"/FlateDecode", zlib.compress(b"BT (x y) Tj ET")), (b"/ASCIIHexDecode", b"BT (x y) Tj ET".hex().encode() + b">"), (b"/RunLengthDecode", bytes([13]) + b"BT (x y) Tj ET" + b"\x80")):
        assert _open(_plain(_page(packed, filters=b"/Filter " + name))).text(0) == "x y"


def test_forms_inherited_resources_and_updates():
    objects = _page(b"q /X1 Do Q BT /F1 1 Tf (page) Tj ET")
    objects[2] = objects[2].replace(b"/Font", b"/XObject << /X1 6 0 R >> /Font")
    inner = b"BT /F1 1 Tf (form) Tj ET /X1 Do"  # calls itself
    objects[6] = b"<< /Subtype /Form /Length %d >>\nstream\n" % len(inner) + inner + b"\nendstream"
    assert set(_open(_plain(objects)).text(0).split("\n")) == {"form", "page"}
    first = _plain(_page(b"BT (old) Tj ET"))
    new = b"4 0 obj << /Length 14 >>\nstream\nBT (new) Tj ET\nendstream endobj\n"
    at, before = len(first) + 1, int(first.rsplit(b"startxref\n", 1)[1].split()[0])
    update = first + b"\n" + new + b"xref\n4 1\n%010d 00000 n \ntrailer << /Size 6 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, before, at + len(new))
    assert _open(update).text(0) == "new"


def test_damaged_files_are_mended_or_refused():
    whole = _plain(_page(b"BT (text) Tj ET"))
    assert _open(whole.replace(b"startxref", b"startxxxx")).text(0) == "text"  # found by headings
    assert _open(b"junk before " + whole).text(0) == "text"
    packed = pdf.written(PAGES)
    assert [_open(packed[: packed.rindex(b"startxref")]).text(i) for i in range(3)] == PAGES
    for bad in (b"", b"no pdf", b"%PDF-1.4", b"%PDF-1.7\nstartxref\n5\n%%EOF", _plain(_page(b""), extra="/Encrypt 5 0 R"), b"%PDF-1.4 1 0 obj [" + b"[" * 5000):
        with pytest.raises(pdf.PdfError):
            _open(bad)
    loop = _page(b"")
    loop[2] = b"<< /Type /Pages /Kids [2 0 R 3 0 R 3 0 R] /Count 3 >>"
    assert len(_open(_plain(loop))) == 1
    lzw = _open(_plain(_page(b"x", filters=b"/Filter /LZWDecode")))
    with pytest.raises(pdf.PdfError, match="LZWDecode"):
        lzw.text(0)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_damage_never_crashes(seed):
    rng = random.Random(seed)
    for _ in range(600):
        data = bytearray(pdf.written(PAGES, rng.random() < 0.5))
        for _ in range(rng.randint(1, 30)):
            at = rng.randrange(len(data))
            if rng.random() < 0.6:
                data[at] = rng.randrange(256)
            elif rng.random() < 0.5:
                del data[at : at + rng.randint(1, 50)]
            else:
                data[at:at] = rng.randbytes(rng.randint(1, 20))
        try:
            document = _open(bytes(data))
            for i in range(len(document)):
                document.text(i)
        except pdf.PdfError:
            pass


@pytest.fixture()
def engine(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    book = np.random.default_rng(0).normal(size=(101, 16))
    return Engine(spark, Config(watch_folder=str(docs), store=str(tmp_path / "store")), CodebookEncoder(book / np.linalg.norm(book, axis=1, keepdims=True)))


def test_pdf_files_are_ingested_and_searched(engine, tmp_path):
    docs = tmp_path / "docs"
    (docs / "a.pdf").write_bytes(pdf.written([f"words of page{i}" for i in range(1, 20)]))
    (docs / "b.pdf").write_bytes(pdf.written(["yellow\npink"], packed=False))
    (docs / "torn.pdf").write_bytes(b"%PDF-1.4 torn")
    (docs / "none.pdf").write_bytes(_plain({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [] /Count 0 >>"}))
    (docs / "text.pdf").write_text("brown\fgrey")
    assert engine.start() == {"done": 3, "failed": 2}
    rows = {os.path.basename(r.file_path): r for r in engine.documents().collect()}
    assert rows["a.pdf"].num_pages == 19 and rows["text.pdf"].num_pages == 2
    assert rows["none.pdf"].error_message == ingestion.NO_PAGES and "page tree" in rows["torn.pdf"].error_message
    best = engine.query("yellow pink", 1).first()
    assert (best.filename, best.page_number) == ("b.pdf", 1)
    assert engine.page(str(docs / "a.pdf"), 19) == "words of page19" and engine.query("page7", 50).where("filename = 'a.pdf'").count() == 19


def test_no_contents_in_rows(spark, engine, tmp_path):
    found = spark.createDataFrame([("h", str(tmp_path / "docs" / "x.pdf"))], "file_hash string, file_path string")
    counts = ingestion.counted(found, ingestion.DocumentPages())
    plan = ingestion.rendered(counts, ingestion.DocumentPages())._jdf.queryExecution().optimizedPlan().toString()
    assert "binary" not in counts.schema.simpleString() and "content#" not in plan.split("MapInArrow")[-1]
    assert "No such file" in counts.first().error_message


def test_files_without_hashes_are_spread_and_counted_once(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.pdf").write_bytes(b"%PDF-1.4 torn" if i == 7 else pdf.written([f"text {i}", "more"]))
    found = files.listing(spark, str(tmp_path)).select("file_path", F.lit("").alias("file_hash"))
    counts = ingestion.counted(found, ingestion.DocumentPages())
    pages = ingestion.rendered(counts, ingestion.DocumentPages())
    for made in (counts, pages):
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 4 and max(sizes) < 20
    assert pages._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    rows = pages.collect()
    assert sorted(r.content for r in rows if r.page_number == 1) == sorted(f"text {i}" for i in range(40) if i != 7)
    assert [(os.path.basename(r.file_path), r.page_number, r.content) for r in rows if r.error_message] == [("7.pdf", None, None)]


# folders


def test_listing_hashes_by_pieces(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"x" * (3 * folders.PIECE + 7))
    (tmp_path / "deep" / "b.PDF").write_bytes(b"y")
    for name in ("empty.pdf", ".hidden.pdf", "_part.pdf", "note.txt"):
        (tmp_path / name).write_bytes(b"" if name == "empty.pdf" else b"z")
    with open(tmp_path / "huge.pdf", "wb") as f:  # beyond what a row can hold
        f.truncate((1 << 31) + 5)
    rows = {os.path.basename(r.file_path): r for r in files.documents(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.pdf", "b.PDF", "huge.pdf"} and rows["huge.pdf"].length == (1 << 31) + 5
    assert rows["a.pdf"].file_hash == hashlib.sha256(b"x" * (3 * folders.PIECE + 7)).hexdigest()
    assert {os.path.basename(r.file_path) for r in files.listing(spark, str(tmp_path), recursive=False).collect()} == {"a.pdf", "huge.pdf"}
    assert files.documents(spark, str(tmp_path / "not there")).count() == 0
    some = spark.createDataFrame([(str(tmp_path / "deep" / "b.PDF"),), (str(tmp_path / "gone.pdf"),)] * 2, "file_path string")
    assert [tuple(r) for r in folders.hashed(some).collect()] == [(str(tmp_path / "deep" / "b.PDF"), hashlib.sha256(b"y").hexdigest())]


def test_tasks_are_bounded(tmp_path, monkeypatch):
    for i in range(10):
        (tmp_path / f"{i}.pdf").write_bytes(b"x" * (10 + i))
    found = folders.entries(str(tmp_path), folders.PDF, True)
    assert [len(t) for t in folders._tasks(found, 30)] == [2, 2, 2, 1, 1, 1, 1]
    monkeypatch.setattr(folders, "TASK_FILES", 4)
    assert [len(t) for t in folders._tasks(found, None)] == [4, 4, 2]


def _reader(tmp_path, **options):
    return folders.Versions({"path": str(tmp_path / "docs"), "state": str(tmp_path / "state"), **options})


def _rows(reader, start, end):
    return sorted((os.path.basename(p), c, v) for part in reader.partitions(start, end) for b in reader.read(part) for p, c, _, _, v in zip(*(x.to_pylist() for x in b.columns), strict=True))


def test_a_file_is_taken_when_two_listings_agree(tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    reader = _reader(tmp_path)
    assert reader.latestOffset() == reader.initialOffset()
    (docs / "a.pdf").write_bytes(b"1")
    assert reader.latestOffset() == {"version": 0}
    (docs / "a.pdf").write_bytes(b"12")  # still written
    assert reader.latestOffset() == {"version": 0}
    assert reader.latestOffset() == {"version": 1} == reader.latestOffset()
    assert _rows(reader, {"version": 0}, {"version": 1}) == [("a.pdf", "created", 1)]
    os.rename(docs / "a.pdf", docs / "b.pdf")
    assert reader.latestOffset() == {"version": 2} and reader.latestOffset() == {"version": 3}
    assert _rows(reader, {"version": 1}, {"version": 3}) == [("a.pdf", "deleted", 3), ("b.pdf", "created", 3)]
    (docs / "b.pdf").write_bytes(b"123")
    assert reader.latestOffset() == {"version": 3} and reader.latestOffset() == {"version": 4}  # held as it was until settled
    assert _rows(reader, {"version": 3}, {"version": 4}) == [("b.pdf", "modified", 4)]


@pytest.mark.parametrize("seed", range(4))
def test_every_change_comes_once_from_any_crash_point(tmp_path, seed):
    """The reader is thrown away at random: after a listing was kept, before and after a batch, before a commit."""
    rng = random.Random(seed)
    docs = tmp_path / "docs"
    docs.mkdir()
    reader, done, seen, there = _reader(tmp_path, settle="false"), {"version": 0}, {}, {}
    for step in range(60):
        name = f"{rng.randint(0, 5)}.pdf"
        if rng.random() < 0.3 and name in there:
            os.remove(docs / name)
            del there[name]
        else:
            there[name] = "x" * (step + 1)
            (docs / name).write_text(there[name])
        end = reader.latestOffset()
        if rng.random() < 0.3:
            reader = _reader(tmp_path, settle="false")  # the offset was not logged
            continue
        first = _rows(reader, done, end)
        if rng.random() < 0.3:
            reader = _reader(tmp_path, settle="false")  # the batch was planned but not ended: it runs again as it was
        assert _rows(reader, done, end) == first
        for path, change, _ in first:
            assert (path in seen) == (change != "created")
            if change == "deleted":
                del seen[path]
            else:
                seen[path] = True
        done = end
        if rng.random() < 0.7:
            reader.commit(end)
    end = reader.latestOffset()
    for path, change, _ in _rows(reader, done, end):
        seen.pop(path, None) if change == "deleted" else seen.setdefault(path, True)
    assert set(seen) == set(there)
    reader.commit(end)
    assert reader._versions() == [end["version"]]


def test_a_version_is_whole_or_not_there(tmp_path, monkeypatch):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.pdf").write_bytes(b"1")
    reader = _reader(tmp_path, settle="false")
    monkeypatch.setattr(folders.pq, "write_table", lambda *a, **k: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        reader.latestOffset()
    monkeypatch.undo()
    reader = _reader(tmp_path, settle="false")
    assert reader._versions() == [] and reader.latestOffset() == {"version": 1}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    docs, got = tmp_path / "docs", []
    docs.mkdir()

    def run():
        stream = watch.changed_files(ship(spark), str(docs), str(tmp_path / "listings"), settle=False)
        watch.start(stream, str(tmp_path / "stream"), lambda come, gone: got.extend((os.path.basename(r.file_path), r.change) for r in come.union(gone).collect())).awaitTermination()

    (docs / "a.pdf").write_text("1")
    (docs / "b.pdf").write_text("1")
    run()
    (docs / "b.pdf").write_text("12")
    os.remove(docs / "a.pdf")
    (docs / "c.pdf").write_text("1")
    run()
    run()
    assert sorted(got[:2]) == [("a.pdf", "created"), ("b.pdf", "created")]
    assert sorted(got[2:]) == [("a.pdf", "deleted"), ("b.pdf", "modified"), ("c.pdf", "created")]


def test_watch_opens_only_what_changed(spark, engine, tmp_path, monkeypatch):
    docs = tmp_path / "docs"
    (docs / "a.pdf").write_text("red")
    (docs / "b.pdf").write_text("green")
    engine.registry.initialise()
    engine.store.initialise()
    engine.watch(str(tmp_path / "checkpoint")).awaitTermination()
    asked = []
    hashed = folders.hashed
    monkeypatch.setattr(folders, "hashed", lambda come: (asked.extend(os.path.basename(r.file_path) for r in come.collect()), hashed(come))[1])
    (docs / "b.pdf").write_text("green and more")
    engine.watch(str(tmp_path / "checkpoint")).awaitTermination()
    assert asked == ["b.pdf"] and engine.query("more", 10).where("filename = 'b.pdf'").count() == 2


# files written


def test_files_are_written_or_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.bin", b"1"), ("y.bin", None)], "name string, content binary")
    sink.save_files(rows, str(tmp_path / "out"))
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*.bin")} == {"a/x.bin": b"1", "y.bin": b""}
    bad = spark.createDataFrame([(f"{i}.bin" if i < 40 else None, b"2") for i in range(41)], "name string, content binary").repartition(4)
    with pytest.raises(Exception, match="needs a name"):
        sink.save_files(bad, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["a", "y.bin"]
    sink.save_files(rows.limit(1), str(tmp_path / "out"), mode="overwrite")
    assert sorted(os.listdir(tmp_path / "out")) == ["a"]


def test_npy_files(spark, tmp_path):
    array = np.arange(24, dtype=np.float32).reshape(3, 4, 2)
    rows = [("h", i + 1, 4, 2, array[i].tobytes()) for i in (2, 0, 1)] + [("g", 1, 1, 2, array[0, :1].tobytes())]
    pages = spark.createDataFrame(rows, "file_hash string, page_number int, n_tokens int, dim int, flat binary")
    sink.save_files(sink.npy_files(pages), str(tmp_path / "npy"))
    assert np.array_equal(np.load(tmp_path / "npy" / "h.npy"), array) and np.load(tmp_path / "npy" / "g.npy").shape == (1, 1, 2)
    back = files.npy_embeddings(spark, str(tmp_path / "npy"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pages.collect()))
    with pytest.raises(Exception, match="shapes"):
        sink.npy_files(pages.selectExpr("'one' as file_hash", "page_number", "n_tokens", "dim", "flat")).collect()


def test_the_driver_holds_no_names_of_many_files(spark, tmp_path, monkeypatch):
    rows = spark.range(300).selectExpr("'d' || id % 3 || '/' || id || '.txt' as name", "cast(cast(id as string) as binary) as content").repartition(6)
    writer = sink._Writer(str(tmp_path / "direct"), False)
    for task in range(2):
        for k in range(50):
            at = tmp_path / "direct" / writer.attempt / str(task) / f"d{k % 2}"
            at.mkdir(parents=True, exist_ok=True)
            (at / f"{task}-{k}.txt").write_bytes(b"x")
    writer.commit([sink._Written(0), None, sink._Written(1)])
    assert len(list((tmp_path / "direct").rglob("*.txt"))) == 100 and sorted(os.listdir(tmp_path / "direct")) == ["d0", "d1"]
    sink.save_files(rows, str(tmp_path / "out"))
    monkeypatch.setattr(folders, "LISTED", 50)
    lister = folders._Lister({"path": str(tmp_path / "out"), "pattern": "*.txt", "tasks": "5"})
    parts = lister.partitions()
    assert len(parts) == 5 and len(pickle.dumps(parts)) < 1000
    read = [b.to_pylist() for p in parts for b in lister.read(p)]
    assert max(map(len, read)) <= 100
    found = {os.path.basename(r["file_path"]): r for b in read for r in b}
    assert sum(map(len, read)) == len(found) == 300 and found["7.txt"]["file_hash"] == hashlib.sha256(b"7").hexdigest()
    whole = {r["file_path"]: r for r in folders.entries(str(tmp_path / "out"), "*.txt", True).to_pylist()}
    assert {r["file_path"]: (r["modified"], r["length"]) for r in found.values()} == {p: (r["modified"], r["length"]) for p, r in whole.items()}
