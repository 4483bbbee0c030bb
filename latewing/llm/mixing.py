"""Mixing sources to target weights.

Every document gets a hash-random key; within its source documents are ordered by that key, running sums of their
sizes are formed, and the order is cut where the source's budget of words is used up.  A budget above the source's
size first takes the whole source, as often as it fits (epochs), and cuts the rest.

Nothing runs over a whole source in one task.  The order is cut into ranges of neighbouring keys, as many per source
as its rows ask for, so that all ranges hold about as many rows whatever the source; running sums of their totals say in
which range a source's budget ends, and running sums in that range on which row.  A small table with one row per source
then says all: whether a row is taken follows from its key alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latewing.llm import shared


@F.arrow_udf(T.LongType())
def count_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Number of words of each text; null: 0."""
    for batch in shared.lean(batches):
        yield pa.array(shared.word_counts(batch), pa.int64())


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source of (source, size): source, n_rows, source_size, target.

    Sources in code-point order, null last, weigh ``weights``, repeating.  Together they get ``share`` times all sizes.
    A target stops at ``cap`` times its source's size and the excess is shared again by weight.  That ends where one
    level serves all sources: target = min(cap, level * weight).  Ordered by cap / weight the sources at their cap come
    first, so the level follows from two running sums; its table has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    return (
        sizes.groupBy("source")
        .agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("cap", cap * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all", share * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(rest))
        # the first source, by ratio, whose level does not reach its ratio sets the level of all that follow
        .withColumn("set", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level"))).over(Window.partitionBy()))
        .select(
            "source", "n_rows", "source_size",
            F.when(F.col("set").isNull() | (F.col("ratio") < F.col("set.ratio")), F.col("cap"))
            .otherwise(F.least("cap", F.col("set.level") * F.col("weight"))).alias("target"),
        )
    )


def _key(seed: int):
    """The hash-random key of a row, 52 bits of the md5 of its id (a null id: of its text's hash): reruns agree."""
    name = F.coalesce(F.col("row_id").cast("string"), F.concat(F.lit("~"), F.col("text_print").cast("string")))
    return F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long")


def _printed(sizes: DataFrame) -> DataFrame:
    """``sizes`` with a text_print: the same for all rows, unless they have one."""
    return sizes if "text_print" in sizes.columns else sizes.withColumn("text_print", F.lit(0).cast("long"))


def cuts(sizes: DataFrame, folder: str, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per source of (row_id, text_print, source, size): source, source_size, target, epochs that take all of it,
    and where the last, cut epoch ends: cut_key, cut_id, cut_print, and the words that a row on the cut gives (cut_words).

    Totals of ranges of keys say which range a source's cut lies in; only that range is sorted, and running sums in it
    find the row.  Rows with equal id and text are one item of their joint size; a cut inside such an item takes the
    same number of words of each of its rows, so less than a word of each is lost.
    """
    targets = shared.stored(source_targets(sizes, weights, share, cap), folder, "targets")
    total = targets.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    per_range = max(500, int(total**0.5))  # both the rows of a range and the number of ranges stay small
    budget = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    named = F.struct(F.col("source").isNull(), F.coalesce(F.col("source"), F.lit(""))).alias("named")
    plan = targets.withColumn("epochs", full).withColumn("rest", budget - full * F.col("source_size")).select(named, "source", "n_rows", "source_size", "target", "epochs", "rest")
    u = F.col("key") / F.lit(float(1 << 52))
    items = sizes.where("size > 0").select(named, "row_id", "text_print", "size", _key(seed).alias("key"))
    placed = items.join(plan.select("named", "n_rows", "rest"), "named").withColumn("range", F.floor(u * F.ceil(F.col("n_rows") / per_range)).cast("int"))
    running = Window.partitionBy("named").orderBy("range")
    sums = placed.groupBy("named", "range").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    sums = sums.withColumn("end", F.sum("size").over(running)).where((F.col("end") > F.col("rest")) & (F.col("end") - F.col("size") <= F.col("rest")))
    held = placed.drop("rest").join(sums.select("named", "range", (F.col("rest") - F.col("end") + F.col("size")).alias("left")), ["named", "range"])
    held = held.groupBy("named", "key", "row_id", "text_print").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.first("left").alias("left"))
    running = Window.partitionBy("named").orderBy("key", F.col("row_id").asc_nulls_first(), "text_print")
    on_cut = held.withColumn("end", F.sum("size").over(running)).where((F.col("end") > F.col("left")) & (F.col("end") - F.col("size") <= F.col("left")))
    words = F.floor((F.col("left") - F.col("end") + F.col("size")) / F.col("rows")).cast("long")
    ends = on_cut.select("named", F.col("key").alias("cut_key"), F.col("row_id").alias("cut_id"), F.col("text_print").alias("cut_print"), words.alias("cut_words"))
    return shared.stored(plan.join(ends, "named", "left").drop("named", "n_rows", "rest"), folder, "cuts")


def _last(seed: int, whole, part):
    """What the cut epoch takes of a row joined with its source's row of ``cuts``: ``whole``, ``part`` on the cut, or 0."""
    before = F.struct(_key(seed).alias("k"), F.col("row_id").alias("i"), F.col("text_print").alias("p"))
    at = F.struct(F.col("cut_key").alias("k"), F.col("cut_id").alias("i"), F.col("cut_print").alias("p"))
    return F.when(F.col("cut_key").isNull(), F.lit(0)).when(before < at, whole).when(before.eqNullSafe(at), part).otherwise(F.lit(0))


def mix(sizes: DataFrame, folder: str, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """(row_id, source, size and, if ids repeat, text_print) -> row_id, source, size, source_size, target, taken: the
    words of each row that the mix takes.

    ``taken`` counts repeats: a row in the last, cut epoch is taken once more than one behind the cut, and the row on
    the cut is taken in part, so that a source's ``taken`` add up to its target rounded down (or, with rows that repeat
    both id and text on the cut, to less than one word of each below).  Rows of size 0 are returned with taken 0.
    An empty table gives an empty table.
    """
    sizes = _printed(sizes)
    ends = cuts(sizes, folder, weights, share, cap, seed).withColumnRenamed("source", "_source")
    # a row per source: broadcast only if Spark finds it small
    both = sizes.join(ends, F.col("source").eqNullSafe(F.col("_source")))
    return both.select("row_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + _last(seed, F.col("size"), F.col("cut_words"))).alias("taken"))


def mixed_documents(docs: DataFrame, folder: str, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) as the mix takes them: every row once per epoch that takes it
    whole, and the row on a source's cut once more with the text ended after the last word taken.

    Rows that the mix does not take are gone.  Null texts have no words and go too.  Rows that repeat both doc_id and
    text are taken alike.  Columns pass through, whatever their names.  Texts are read twice, to count their words and to
    take them; they are never shuffled.
    """
    (whole,) = shared.free_names(["text_print"], "document")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), F.col("doc_id").alias("row_id"), F.col("source"), F.col("text"))
    rows = rows.withColumn("text_print", F.xxhash64("text"))
    sizes = shared.stored(rows.select("row_id", "text_print", "source", count_words("text").alias("size")), folder, "sizes")
    ends = cuts(sizes, folder, weights, share, cap, seed).withColumnRenamed("source", "_source")
    both = rows.join(ends, F.col("source").eqNullSafe(F.col("_source")))
    copies = F.col("epochs") + _last(seed, F.lit(1), F.lit(0))
    # only texts on a cut go to Python, and null ones and those without a word go away
    short = first_words(F.when(_last(seed, F.lit(0), F.col("cut_words")) > 0, F.col("text")), F.col("cut_words"))
    taken = both.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(whole, copies.alias("copies"), short.alias("short"))
    parts = F.concat(F.array_repeat(F.lit(True), F.col("copies").cast("int")), F.when(F.col("short").isNotNull(), F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    each = taken.select(whole, "short", F.explode(parts).alias("entire"))
    text = F.when(F.col("entire"), F.col(f"{whole}.text")).otherwise(F.col("short"))
    return each.select(*[text.alias(c) if c == "text" else F.col(f"{whole}.`{c}`").alias(c) for c in docs.columns])


@F.arrow_udf(T.StringType())
def first_words(texts: pa.Array, n: pa.Array) -> pa.Array:
    """Each text up to the end of its n-th word; null stays null."""
    out = []
    for text, k in zip(texts, n, strict=True):
        if not text.is_valid:
            out.append(None)
            continue
        data, offsets = shared.text_bytes(pa.array([text.as_py()], pa.string()))
        _, ends, _ = shared.word_spans(data, offsets)
        k = k.as_py()
        out.append(data[: ends[min(k, len(ends)) - 1]].tobytes().decode() if k > 0 and len(ends) else "")
    return pa.array(out, pa.string())


def op4(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    folder = shared.shared_folder(spark)
    sizes = docs.select(F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("text_print"), "source", count_words("text").alias("size"))
    mixed = mix(shared.stored(sizes, folder, "sizes"), folder)
    return mixed.select(F.col("row_id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


SQL = r"""
with sizes as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as n from sizes group by source
), weighed as (
  select *, [3.0, 1.0, 2.0][((n - 1) % 3 + 1)::int]::double as weight, 2.0::double * source_size as cap from sources
), levels as (
  select *, cap / weight as ratio,
    (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, n rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by cap / weight, n rows between current row and unbounded following) as level
  from weighed
), settled as (
  select *, (select min({'r': ratio, 'l': level}) from levels where level < ratio) as s from levels
), targets as (
  select source, source_size, case when s is null or ratio < s.r then cap else least(cap, s.l * weight) end as target from settled
), placed as (
  select doc_id, sizes.source, size, source_size, target, cast(floor(target) as bigint) as budget,
    coalesce(sum(size) over (partition by sizes.source order by cast('0x' || substr(md5(doc_id || ':17'), 1, 13) as bigint), doc_id rows between unbounded preceding and 1 preceding), 0) as start
  from sizes join targets on sizes.source is not distinct from targets.source
), epochs as (
  select *, case when source_size > 0 then budget // source_size else 0 end as epochs from placed
)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) as bigint) as taken, source from epochs
"""
