import hashlib
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latewing.operators import registry as R
from latewing.sources.snapshots import Conflict, Part, Snapshots
from latewing.sources.store import EmbeddingStore


def fold(ops):
    """The rules of the registry, one operation after another."""
    rows = {}
    for seq, op, key, path, pages, blob, error in sorted(ops):
        row = rows.get(key)
        if op == "delete":
            rows.pop(key, None)
        elif op == "reset":
            if row and row["status"] == "processing":
                row["status"] = "pending"
        elif op == "failed":
            if row:
                row.update(path=path, status=op, error=error)
        elif row is None:
            rows[key] = {"path": path, "status": op, "error": None, "pages": (pages or 0) if op == "done" else 0, "blob": blob if op == "done" else None, "seq": seq}
        elif op == "pending":
            if row["status"] != "done":
                row["path"] = path
        elif op == "processing":
            row.update(path=path, status=op)
        else:
            row.update(path=path, status=op, error=None, pages=pages or 0, blob=blob)
    return rows


def random_log(n, keys, seed):
    rng = random.Random(seed)
    ops = ["pending", "processing", "done", "failed", "reset", "delete"]
    return [(i, rng.choice(ops), f"k{rng.randrange(keys)}", f"p{i}", rng.randrange(9), f"b{i}", f"e{i}") for i in range(n)]


def frame(spark, ops):
    df = spark.createDataFrame(ops, "seq long, op string, file_hash string, file_path string, num_pages int, embedding_path string, error_message string")
    return df.withColumn("at", F.timestamp_seconds("seq"))


def as_rows(df):
    return {r.file_hash: {"path": r.file_path, "status": r.status, "error": r.error_message, "pages": r.num_pages, "blob": r.embedding_path, "seq": r.ingest_seq} for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_fold_and_compaction_follow_the_state_machine(spark, seed):
    ops = random_log(400, 40, seed)
    log = frame(spark, ops)
    want = fold(ops)
    assert as_rows(R.registry_of(log)) == want
    small = R.compacted(log)
    again = as_rows(R.registry_of(small))
    assert {k: {f: v for f, v in r.items() if f not in ("seq", "error")} for k, r in again.items()} == {k: {f: v for f, v in r.items() if f not in ("seq", "error")} for k, r in want.items()}
    assert {k for k, r in again.items() if r["status"] == "failed" and r["error"]} == {k for k, r in want.items() if r["status"] == "failed"}
    assert sorted(again, key=lambda k: again[k]["seq"]) == sorted(want, key=lambda k: want[k]["seq"])
    assert small.groupBy("file_hash").count().agg(F.max("count")).first()[0] <= 3


def test_methods(spark, tmp_path):
    reg = R.Registry(spark, str(tmp_path))
    reg.initialise()
    reg.initialise()
    assert reg.all().count() == 0 and reg.reset_in_progress() == 0
    reg.failed("h0", "/a.pdf", "x")  # no row yet: nothing
    assert reg.all().count() == 0
    reg.processing("h1", "/d/a.pdf")
    reg.processing("h2", "/d/b.pdf")
    reg.done("h1", "/d/a.pdf", 3, "s/h1")
    reg.pending("h1", "/elsewhere.pdf")  # done stays
    reg.done("h3", "/d/a.pdf", 1, "s/h3")  # the file was edited: both contents stay
    assert [(r.file_hash, r.status, r.file_path) for r in reg.all().collect()] == [("h1", "done", "/d/a.pdf"), ("h2", "processing", "/d/b.pdf"), ("h3", "done", "/d/a.pdf")]
    assert reg.by_hash("h1").first().num_pages == 3 and reg.by_hash("nope").count() == 0
    assert reg.by_path("/d/../d//a.pdf").first().file_hash == "h1"
    assert reg.reset_in_progress() == 1 and reg.by_hash("h2").first().status == "pending"
    assert [r.file_hash for r in reg.delete_by_path("/d/a.pdf").collect()] == ["h1"]  # one row
    assert [r.file_hash for r in reg.all().collect()] == ["h2", "h3"]
    assert reg.delete_by_hash("nope").count() == 0
    assert tuple(reg.status().first()) == (2, 1)


@pytest.mark.parametrize("seed", range(3))
def test_reduced_stretches_fold_like_the_whole(spark, seed):
    rng = random.Random(seed)
    ops = random_log(500, 12, seed + 50)
    log = frame(spark, ops)
    cuts = sorted(rng.sample(range(500), 4))
    pieces = [log.where(F.col("seq").between(a, b - 1)) for a, b in zip([0, *cuts], [*cuts, 500], strict=True)]
    made = R.reduced(pieces[0])
    for piece in pieces[1:]:
        made = R.reduced(made.unionByName(R.reduced(piece)))
    rows = made.collect()
    assert as_rows(R.registry_of(made)) == fold(ops) == as_rows(R.registry_of(R.reduced(log)))
    assert len(rows) == len(set(rows)) and max(Counter(r.file_hash for r in rows).values()) <= 7


def _ops(spark, rows):
    return frame(spark, rows).drop("at")


@pytest.mark.parametrize("seed", range(2))
def test_merged_log_equals_the_full_fold(spark, tmp_path, seed):
    ops = random_log(300, 10, seed + 90)
    reg = R.Registry(spark, str(tmp_path))
    reg.MERGE = 3
    for at in range(0, 300, 30):
        reg.append(_ops(spark, [(o[0] - at, *o[1:]) for o in ops[at : at + 30]]))
    assert as_rows(reg.table()) == fold(ops)
    parts = reg.parts.manifest().parts
    assert [p.level for p in parts] == [2, 0] and reg.log().count() < 300  # nine appends are one part of level 2
    assert reg.parts.manifest().next_seq == 300
    before = as_rows(reg.table())
    assert reg.clean(older_than=0) > 0 and as_rows(reg.table()) == before
    row = fold(ops)
    key = next(iter(row))
    assert as_rows(reg.by_hash(key)) == {key: row[key]}
    assert as_rows(reg.by_path("x/../" + row[key]["path"])) == {key: row[key]}


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    regs = [R.Registry(spark, str(tmp_path)) for _ in range(4)]
    regs[0].initialise()
    for r in regs:
        r.MERGE = 3

    def write(k):
        for i in range(4):
            regs[k].append(_ops(spark, [(0, "processing", f"w{k}-{i}", f"p{i}", 0, None, None), (1, "done", f"w{k}-{i}", f"p{i}", i, "b", None)]))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    rows = as_rows(regs[0].table())
    assert set(rows) == {f"w{k}-{i}" for k in range(4) for i in range(4)} and all(r["status"] == "done" for r in rows.values())
    assert len({r["seq"] for r in rows.values()}) == 16  # no two operations share a place
    numbers = regs[0].parts._numbers()
    assert numbers == list(range(1, len(numbers) + 1))


@pytest.mark.parametrize("step", ["written", "_say", "replace", "reduced"])
def test_a_crash_at_any_step_loses_nothing(spark, tmp_path, monkeypatch, step):
    reg = R.Registry(spark, str(tmp_path))
    reg.MERGE = 2
    reg.append(_ops(spark, [(0, "done", "a", "p", 1, "b", None)]))

    def crash(*_, **__):
        raise OSError("lost")

    if step == "reduced":
        monkeypatch.setattr(R, "reduced", crash)
    else:
        monkeypatch.setattr(Snapshots, step, crash)
    with pytest.raises(OSError):
        reg.append(_ops(spark, [(0, "done", "c", "p", 1, "b", None)]))
    monkeypatch.undo()
    held = {"a", "c"} if step in ("replace", "reduced") else {"a"}  # merging comes after the append
    again = R.Registry(spark, str(tmp_path))
    again.MERGE = 2
    assert set(as_rows(again.table())) == held
    again.append(_ops(spark, [(0, "done", "d", "p", 1, "b", None)]))
    assert set(as_rows(again.table())) == held | {"d"}
    again.clean(older_than=0)
    assert set(as_rows(again.table())) == held | {"d"}


def test_a_torn_link_is_another_writers_manifest(spark, tmp_path, monkeypatch):
    """The number is taken between reading and making the manifest: the change is made on what the other said."""
    table = Snapshots(spark, str(tmp_path / "t"), T.StructType([T.StructField("x", T.LongType())]))
    other = Snapshots(spark, str(tmp_path / "t"), table.schema)
    say, taken = Snapshots._say, []

    def late(self, manifest):
        if self is table and not taken:
            taken.append(other.append(spark.range(3).toDF("x")))
        return say(self, manifest)

    monkeypatch.setattr(Snapshots, "_say", late)
    table.append(spark.range(10, 12).toDF("x"))
    assert sorted(r.x for r in table.read().collect()) == [0, 1, 2, 10, 11] and table.manifest().number == 2
    old = table.manifest()
    with pytest.raises(Conflict):
        table.replace((Part("nobody"),), spark.range(1).toDF("x"))
    table.replace(old.parts, spark.range(1).toDF("x"))
    assert table.read().count() == 1 and table.read(old).count() == 5  # a reader goes on with what it began


def test_pages_added_while_the_store_is_compacted_stay(spark, tmp_path, monkeypatch):
    store = EmbeddingStore(spark, str(tmp_path))
    pages = lambda name: spark.createDataFrame([(name, 1, 1, 2, [1.0, 2.0])], "file_hash string, page_number int, n_tokens int, dim int, flat array<float>")
    store.append(pages("a"), "one")
    store.append(pages("b"), "two")
    named = spark.createDataFrame([("a", "s#one")], "file_hash string, embedding_path string")
    replace_parts = Snapshots.replace

    def meanwhile(self, *args, **kw):
        monkeypatch.undo()
        store.append(pages("c"), "three")
        return replace_parts(self, *args, **kw)

    monkeypatch.setattr(Snapshots, "replace", meanwhile)
    store.compact(named)
    assert sorted(r.file_hash for r in store.read().collect()) == ["a", "c"]
    assert store.clean(older_than=0) == 0  # older manifests may still be read
    monkeypatch.setattr(Snapshots, "KEPT", 0)
    assert store.clean(older_than=0) == 2 and store.read().count() == 2


def test_lookups_skip_row_groups(spark, tmp_path):
    """A hash or path that a row group's filter does not hold is not read there."""
    reg = R.Registry(spark, str(tmp_path))
    reg.parts.options |= {"parquet.block.size": "20000", "parquet.page.size": "4000", "parquet.block.size.row.check.min": "100", "parquet.page.size.row.check.min": "100"}
    n = 20_000
    rows = spark.range(n).selectExpr("id as seq", "'done' as op", "sha2(cast(id as string), 256) as file_hash", "'/d/' || id || '.pdf' as file_path", "1 as num_pages", "'b' as embedding_path")
    reg.append(rows.coalesce(1))

    def read(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().head()
        while "Scan" not in scan.nodeName():
            scan = scan.plan().collectLeaves().head() if hasattr(scan, "plan") else scan.executedPlan().collectLeaves().head()
        return scan.metrics().apply("numOutputRows").value()

    key = hashlib.sha256(b"777").hexdigest()
    assert read(reg.log().where(F.col("file_hash") == key)) < n / 4
    assert read(reg._stored().where(F.col("normal_path") == "/d/777.pdf")) < n / 4
    assert reg.by_path("/d/x/../777.pdf").first().file_hash == key
