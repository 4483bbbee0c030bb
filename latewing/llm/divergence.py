"""How far the sources of a language differ in their words, over all pairs of sources.

Every source gives every kept term of its language a smoothed share ``p``, in billionths.  The distance of source g from
source h is the sum over all kept terms of ``f(p_g, p_h)``, where ``f(p, q)`` is (p - q)^2 / q rounded down.  Most terms
occur in few sources, so the sum is not taken term by term.  It starts at the number of terms times the ``f`` of two zero
counts, and an inverted index corrects it:

* a term that only one of the two holds changes the sum by what its count alone decides, so sources are joined with
  another's *histogram of counts*, not with its terms;
* a term that both hold is found in the term's postings, and adds what those two one-sided corrections leave open.

Words are counted in bounded Arrow tasks; all that follows is joins and sums of whole numbers with partial results; what is sorted is a source's list of others, and of its
terms no more than ``top`` per task.  The number of rows of the posting join is the sum over terms of the pairs of sources
that hold the term, never more than pairs of the result times terms that both have.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latewing.llm import shared

#: A term is a run of ASCII letters and of characters beyond ASCII.  In UTF-8 every other character is one byte, so
#: bytes say it all: letters become small, what parts terms a space.
_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TO_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256))

#: Distinct terms of sources that a task counts before it passes them on.
HELD_TERMS = 300_000

#: The unit of shares.
WHOLE = 1_000_000_000


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_TERMS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of what the rows hold, for many rows at a time."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def passed_on() -> pa.RecordBatch:
        groups = [(*key, n, docs) for key, (n, docs) in held.items()]
        sizes = [len(n) for _, _, n, _ in groups]
        names = [pa.array(np.repeat(np.array([g[i] for g in groups], object), sizes), pa.string()) for i in (0, 1)]
        terms = pa.array([t for g in groups for t in g[2]], pa.binary()).cast(pa.string())
        n = pa.array([x for g in groups for x in g[2].values()], pa.int64())
        docs = pa.array([g[3][t] for g in groups for t in g[2]], pa.int64())
        held.clear()
        return pa.RecordBatch.from_arrays([*names, terms, n, docs], names=["lang", "source", "term", "n", "docs"])

    for batch in shared.lean(batches):
        for text, *key in zip(*batch.columns, strict=True):
            found = terms_of(text.as_buffer().to_pybytes())
            n, docs = held.setdefault(tuple(k.as_py() for k in key), (Counter(), Counter()))
            n.update(found)
            docs.update(set(found))
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield passed_on()
    if held:
        yield passed_on()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each source, and rows of it that hold the term.

    Nulls are empty strings.  Words are counted before the shuffle.
    """
    rows = docs.select(_text(text).alias("text"), _text(lang).alias("lang"), _text(source).alias("source"))
    counts = rows.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(WHOLE * (n + 1) / (total + terms)), exact; null without terms."""
    over = F.expr(f"CAST({WHOLE} AS decimal(10)) * (CAST({n} AS decimal(20)) + 1)")
    return F.call_function("div", over, F.expr(f"nullif(CAST({total} AS decimal(20)) + {terms}, 0)")) + 1


def _f(p: str, q: str) -> str:
    """SQL of (p - q)^2 / q, rounded down; shares are at most WHOLE + 1, so squares fit in 64 bits."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


@dataclass(frozen=True)
class Index:
    """``postings``: (lang, source, term, n, n_lang) of kept terms; ``groups``: (lang, source, total, total_lang, terms, p0)
    of every source, also of those without a term, ``p0`` being the share of a term that does not occur."""

    postings: DataFrame
    groups: DataFrame


def index(
    docs: DataFrame, folder: str, least_docs: int = 3, text: str = "text", lang: str = "lang", source: str = "source"
) -> Index:
    """The inverted index of the terms that at least ``least_docs`` rows of their language hold, written to ``folder``."""
    counts = shared.stored(term_counts(docs, text, lang, source), folder, "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("held")).where(F.col("held") >= least_docs)
    postings = shared.stored(counts.join(kept.drop("held"), ["lang", "term"]).drop("docs"), folder, "postings")
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    found = docs.select(_text(lang).alias("lang"), _text(source).alias("source")).distinct()
    groups = found.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "terms"])
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"))
    groups = groups.join(whole, "lang").withColumn("p0", _share("0", "total", "terms"))
    return Index(postings, shared.stored(groups, folder, "groups"))


def pair_sums(made: Index) -> DataFrame:
    """(lang, source, other, value): the sum of ``f`` of every ordered pair of sources of a language."""
    groups = made.groups.select("lang", "source", "total", "terms", "p0")
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("r0"))
    base = groups.join(others, "lang").where("source <> other")
    base = base.select("lang", "source", "other", F.expr(f"coalesce(terms * {_f('p0', 'r0')}, 0)").alias("there"), F.lit(0).cast("long").alias("back"))

    counts = made.postings.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    counts = counts.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "terms"))
    single = counts.join(others, "lang").where("source <> other")
    single = single.select(
        "lang", "source", "other",
        F.expr(f"m * ({_f('p', 'r0')} - {_f('p0', 'r0')})").alias("there"),
        F.expr(f"m * ({_f('r0', 'p')} - {_f('r0', 'p0')})").alias("back"),
    )

    priced = made.postings.join(groups, ["lang", "source"]).select("lang", "term", "source", _share("n", "total", "terms").alias("p"), "p0")
    right = priced.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("r"), F.col("p0").alias("r0"))
    both = priced.join(right, ["lang", "term"]).where("source < other")
    both = both.select(
        "lang", "source", "other",
        F.expr(f"{_f('p', 'r')} - {_f('p', 'r0')} - {_f('p0', 'r')} + {_f('p0', 'r0')}").alias("there"),
        F.expr(f"{_f('r', 'p')} - {_f('r0', 'p')} - {_f('r', 'p0')} + {_f('r0', 'p0')}").alias("back"),
    ).where("there <> 0 OR back <> 0")

    sums = [part.groupBy("lang", "source", "other").agg(F.sum("there").alias("there"), F.sum("back").alias("back")) for part in (base, single, both)]
    changes = sums[0].unionByName(sums[1]).unionByName(sums[2])
    directed = changes.select(
        "lang", F.explode(F.array(F.struct("source", "other", F.col("there").alias("value")), F.struct(F.col("other").alias("source"), F.col("source").alias("other"), F.col("back").alias("value")))).alias("x")
    ).select("lang", "x.*")
    return directed.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def telling_terms(made: Index, top: int = 200) -> DataFrame:
    """(lang, source, item, value, rank): the ``top`` terms that a source uses more than its language, by ``f``."""
    groups = made.groups.select("lang", "source", "total", "total_lang", "terms")
    shares = made.postings.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _share("n", "total", "terms").alias("p"), _share("n_lang", "total_lang", "terms").alias("q")
    )
    return _ranked(shares.where("p > q").select("lang", "source", "item", F.expr(_f("p", "q")).alias("value"))).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(
    docs: DataFrame, folder: str, least_docs: int = 3, top: int = 200, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts: ``pair`` (other sources) and ``term``; ``folder`` is a shared one.

    Null texts, languages and sources are empty strings, a language or source of its own.  A source without kept terms has
    pairs and no terms; a language with one source has no pairs.  Each row of ``docs`` is a document, repeated or not; ties
    go by the item's bytes; an empty table gives an empty table.  No column but the three is read.
    """
    made = index(docs, folder, least_docs, text, lang, source)
    pairs = _ranked(pair_sums(made).withColumnRenamed("other", "item")).withColumn("part", F.lit("pair"))
    terms = telling_terms(made, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op13(spark, sf_dir: str) -> DataFrame:
    return audit(shared.table(spark, sf_dir, "documents"), shared.shared_folder(spark))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[a-zA-Z\x{80}-\x{10FFFF}]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row_id) >= 3),
sizes AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, n,
         1 + (1000000000::HUGEINT * (n + 1)) // (cells.total::HUGEINT + terms) AS p,
         1 + (1000000000::HUGEINT * (n_lang + 1)) // (sizes.total::HUGEINT + terms) AS q
  FROM cells JOIN sizes USING (lang)),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(x.value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = g.lang AND x.source = g.source AND x.item = h.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
