"""The queries over the driver's tables and the SQL that says the same.

Pages, documents and queries are made of ``embeddings``: the first 40 vectors are queries of four tokens, the others
pages of ten.  Scores are rounded to four decimals on both sides, and ranks follow the rounded scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewing.functions import texts
from latewing.functions import vectors as V
from latewing.operators import answering, encoding, ingestion, linalg, registry, scoring, search
from latewing.schema import REGISTRY
from latewing.session import shared_root, ship
from latewing.sources import files, folders, pdf, sink, store
from latewing.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))


def _query(embeddings: DataFrame, where: str) -> list[list[float]]:
    """A query's few vectors, encoded on the driver as in search."""
    return [r.vec for r in embeddings.where(where).orderBy("vec_id").select("vec").collect()]


def _pages(embeddings: DataFrame) -> DataFrame:
    return scoring.pack_pages(embeddings.where("vec_id >= 40").withColumn("page", F.expr("vec_id div 10")), ["page"])


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


def _sql_score(q: str, page: str, key: str, extra: str = "", sim: str = "list_dot_product(q.e, p.e)", best: str = "max(s)") -> str:
    """SQL of one query's scores: ``q`` and ``page`` select (e) and (key, e)."""
    return f"""
with q as ({q}), p as ({page}),
sims as (select p.{key}, q.i, {sim} as s from p, q),
best as (select {key}, i, {best} as m from sims group by {key}, i)
select {key}, round(sum(m), 4) as score from best group by {key} {extra}"""


_Q4 = "select vec_id as i, embedding::double[] as e from embeddings where vec_id < 4"
_P10 = "select vec_id // 10 as page, embedding::double[] as e from embeddings where vec_id >= 40"


@query(_sql_score("select vec_id as i, embedding::double[] as e from embeddings where vec_id < 8", _P10, "page"))
def maxsim_single_page(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return _rounded(scoring.score_pages(_pages(e), _query(e, "vec_id < 8")).select("page", "score"), "score")


@query(_sql_score(_Q4, _P10, "page"))
def maxsim_pages(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return _rounded(scoring.score_pages(_pages(e), _query(e, "vec_id < 4")).select("page", "score"), "score")


@query(_sql_score(_Q4, _P10, "page"))
def maxsim_kernel(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    packed = _pages(e).select("page", F.flatten("vectors").alias("flat"))
    return _rounded(scoring.score_packed(packed, _query(e, "vec_id < 4"), ["page"]), "score")


@query(_sql_score(_Q4.replace("< 4", "< 5"), _P10, "page"))
def maxsim_query_len_5(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return _rounded(scoring.score_pages(_pages(e), _query(e, "vec_id < 5")).select("page", "score"), "score")


@query(_sql_score(_Q4, "select label, embedding::double[] as e from embeddings where vec_id >= 40", "label"))
def maxsim_ragged(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return _rounded(scoring.score_tokens(e.where("vec_id >= 40"), _query(e, "vec_id < 4"), ["label"]), "score")


@query("""
select label, cast(count(*) as bigint) as doc_len, cast(coalesce(sum(count(*)) over (order by label rows between unbounded preceding and 1 preceding), 0) as bigint) as first_token
from embeddings group by label""")
def maxsim_flat_offsets(spark, sf_dir):
    lengths = _embeddings(spark, sf_dir).groupBy("label").agg(F.count("*").alias("doc_len"))
    return scoring.ragged_offsets(lengths, "label", "doc_len")


def _flat(embeddings: DataFrame, size: int) -> DataFrame:
    """The whole table as flat buffers of ``size`` neighbouring vectors: batch, flat."""
    rows = F.array_sort(F.collect_list(F.struct("vec_id", "vec")))
    return embeddings.groupBy(F.expr(f"vec_id div {size}").alias("batch")).agg(F.flatten(F.transform(rows, lambda r: r["vec"])).alias("flat"))


_TILED = """
with q as (select vec_id as i, embedding::double[] as e from embeddings where vec_id < 4),
p as (select vec_id // {size} as batch, vec_id % {size} as spot, embedding::double[] as e, count(*) over (partition by vec_id // {size}) as n from embeddings),
placed as (select batch, cast(spot // {width} as int) as part, e from p where spot // {width} < {whole}),
best as (select batch, part, i, max(list_dot_product(q.e, placed.e)) as m from placed, q group by batch, part, i)
select batch, part as {name}, round(sum(m), 4) as score from best group by batch, part"""


@query(_TILED.format(size=10, width=3, whole="3 and spot % 10 < 9", name="doc_idx"))
def maxsim_ragged_batch(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    batches = _flat(e, 10).withColumn("doc_lengths", F.array(*[F.lit(3)] * 3))  # every tenth vector is surplus
    docs = scoring.split_ragged(batches, 64).where(F.size("vectors") > 0)
    return _rounded(scoring.score_pages(docs, _query(e, "vec_id < 4")).select("batch", "doc_idx", "score"), "score")


@query(_TILED.format(size=32, width=7, whole="n // 7", name="tile"))
def maxsim_tiles(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    tiles = scoring.split_tiles(_flat(e, 32), 64, 7)  # 32 tokens: four tiles of seven, four tokens left over
    return _rounded(scoring.score_pages(tiles, _query(e, "vec_id < 4")).select("batch", "tile", "score"), "score")


@query("""
with q as (select vec_id // 4 as query_id, vec_id as i, embedding::double[] as e from embeddings where vec_id < 40),
p as (select vec_id // 10 as page, embedding::double[] as e from embeddings where vec_id >= 40),
sims as (select q.query_id, p.page, q.i, max(list_dot_product(q.e, p.e)) as m from p, q group by all)
select query_id, page, round(sum(m), 4) as score from sims group by query_id, page""")
def maxsim_score_matrix(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    queries = scoring.pack_pages(e.where("vec_id < 40").withColumn("query_id", F.expr("vec_id div 4")), ["query_id"]).withColumnRenamed("vectors", "query_vectors")
    packed = _pages(e).select("page", F.flatten("vectors").alias("flat"))
    return _rounded(scoring.score_matrix_packed(queries, packed, ["page"]).select("query_id", "page", "score"), "score")


@query(f"""
select 7 as dim, page, score from ({_sql_score(_Q4.replace("embedding::", "embedding[1:7]::"), _P10.replace("embedding::", "embedding[1:7]::"), "page")})
union all
select 13 as dim, page, score from ({_sql_score(_Q4.replace("embedding::", "embedding[1:13]::"), _P10.replace("embedding::", "embedding[1:13]::"), "page")})""")
def maxsim_truncated_dim(spark, sf_dir):
    e = _embeddings(spark, sf_dir)

    def cut(dim: int) -> DataFrame:
        short = e.withColumn("vec", F.slice("vec", 1, dim))
        return scoring.score_pages(_pages(short), _query(short, "vec_id < 4")).select(F.lit(dim).alias("dim"), "page", "score")

    return _rounded(cut(7).unionByName(cut(13)), "score")


@query(f"""
with pages as (select distinct vec_id // 10 as page from embeddings where vec_id >= 40 union all select -1), scored as ({_sql_score(_Q4, _P10, "page")})
select pages.page, coalesce(score, 0.0::double) as score from pages left join scored using (page)""")
def maxsim_empty_page(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    empty = spark.range(1).select(F.lit(-1).cast("long").alias("page"), F.array().cast("array<array<float>>").alias("vectors"))
    return _rounded(scoring.score_pages(_pages(e).unionByName(empty), _query(e, "vec_id < 4")).select("page", "score"), "score")


_NAN_P = "select vec_id // 10 as page, case when vec_id % 7 = 0 or vec_id // 10 = 5 then list_transform(embedding::double[], lambda x: 'nan'::double) else embedding::double[] end as e from embeddings where vec_id >= 40"


@query(_sql_score(_Q4, _NAN_P, "page", best="coalesce(max(case when not isnan(s) then s end), '-infinity'::double)"))
def maxsim_nan_policy(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    bad = F.expr("vec_id % 7 = 0 or vec_id div 10 = 5")
    spoiled = e.withColumn("vec", F.when(bad & (F.col("vec_id") >= 40), F.transform("vec", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("vec")))
    return _rounded(scoring.score_pages(_pages(spoiled), _query(e, "vec_id < 4")).select("page", "score"), "score")


@query(_sql_score(_Q4, "select vec_id // 10 as page, list_transform(embedding::double[], lambda x: x * (vec_id % 3 > 0)::int) as e from embeddings where vec_id >= 40", "page"))
def maxsim_masked_tokens(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    masked = e.withColumn("vec", V.masked(F.col("vec"), F.expr("cast(vec_id % 3 > 0 as int)")))
    return _rounded(scoring.score_pages(_pages(masked), _query(e, "vec_id < 4")).select("page", "score"), "score")


@query(_sql_score(_Q4, "select vec_id // 10 as page, list_transform(embedding::double[], lambda x: x * (label = 3)::int) as e from embeddings where vec_id >= 40", "page"))
def maxsim_image_tokens(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    kept = e.withColumn("vec", V.only_tokens(F.col("vec"), F.col("label"), 3))
    return _rounded(scoring.score_pages(_pages(kept), _query(e, "vec_id < 4")).select("page", "score"), "score")


_SIMS = """
select p.page, cast(q.vec_id as int) as q_idx, cast(p.vec_id % 10 as int) as d_idx, round(list_dot_product(q.embedding::double[], p.embedding::double[]), 4) as sim
from (select *, vec_id // 10 as page from embeddings where vec_id >= 40) p, (select * from embeddings where vec_id < 4) q"""


@query(_SIMS)
def similarity_matrix(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    pages = scoring.pack_pages(e.where("vec_id >= 40").withColumn("page", F.expr("vec_id div 10")), ["page"], order="vec_id")
    return _rounded(scoring.similarity_matrix(pages, _query(e, "vec_id < 4"), ["page"]), "sim")


@query(_sql_score(_Q4, _P10, "page"))
def maxsim_unfused(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return _rounded(scoring.score_unfused(scoring.similarity_matrix(_pages(e), _query(e, "vec_id < 4"), ["page"]), ["page"]), "score")


@query("select vec_id, list_max(list_filter(embedding::double[], lambda x: not isnan(x))) as greatest from embeddings")
def vector_max(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", V.vector_max(F.col("vec")).alias("greatest"))


@query("""
with v as (select vec_id, case when vec_id % 50 = 0 then list_transform(embedding::double[], lambda x: 0.0::double) else embedding::double[] end as e from embeddings),
n as (select vec_id, e, greatest(sqrt(list_dot_product(e, e)), 1e-12::double) as norm from v)
select vec_id, cast(i as int) as at, round(e[i + 1] / norm, 4) + 0.0 as x from n, range(0, 64) t(i)""")
def l2_normalize(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    some = e.withColumn("vec", F.when(F.expr("vec_id % 50 = 0"), F.transform("vec", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("vec")))
    long = some.select("vec_id", F.posexplode(V.l2_normalize(F.col("vec"))).alias("at", "x"))
    return long.withColumn("x", F.round("x", 4) + F.lit(0.0))


def _cells(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").cast("int").alias("i"), F.posexplode("vec").alias("j", "v"))


def _grid(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """A made matrix: ((7 i + 3 j) mod 11 - 5) / 10."""
    at = spark.range(rows * columns).selectExpr(f"cast(id div {columns} as int) as i", f"cast(id % {columns} as int) as j")
    return at.selectExpr("i", "j", "cast((7 * i + 3 * j) % 11 - 5 as double) / 10 as v")


def _sql_grid(rows: int, columns: int) -> str:
    return f"select cast(x as int) as i, cast(y as int) as j, ((7 * x + 3 * y) % 11 - 5)::double / 10 as v from range(0, {rows}) a(x), range(0, {columns}) b(y)"


_SQL_CELLS = "select cast(vec_id as int) as i, cast(k as int) as j, embedding[k + 1]::double as v from embeddings, range(0, 64) t(k)"


def _sql_gemm(a: str, b: str, c: str, ta: bool, tb: bool) -> str:
    left = "select j as i, i as k, v from a" if ta else "select i, j as k, v from a"
    right = "select j as k, i as j, v from b" if tb else "select i as k, j, v from b"
    return f"""
with a as ({a}), b as ({b}), c as ({c}), x as ({left}), y as ({right}),
ab as (select x.i, y.j, sum(x.v * y.v) as v from x join y on x.k = y.k group by x.i, y.j)
select coalesce(ab.i, c.i) as i, coalesce(ab.j, c.j) as j, round(0.5::double * coalesce(ab.v, 0) + 0.5::double * coalesce(c.v, 0), 4) + 0::double as v
from ab full join c on ab.i = c.i and ab.j = c.j"""


#: The whole table (a row per vector) times a made matrix; for tn the table, transposed, times itself.
_GEMM = {"nn": ((64, 8), (500, 8)), "nt": ((8, 64), (500, 8)), "tn": (None, (64, 64))}


def _gemm(kind: str):
    other, old = _GEMM[kind]

    def run(spark, sf_dir):
        table_cells = _cells(_embeddings(spark, sf_dir))
        b = _grid(spark, *other) if other else table_cells
        made = _rounded(linalg.gemm(table_cells, b, _grid(spark, *old), 0.5, 0.5, trans_a=kind[0] == "t", trans_b=kind[1] == "t"), "v")
        return made.withColumn("v", F.col("v") + F.lit(0.0))  # no negative zeros

    run.__name__ = f"gemm_{kind}"
    return query(_sql_gemm(_SQL_CELLS, _sql_grid(*other) if other else _SQL_CELLS, _sql_grid(*old), kind[0] == "t", kind[1] == "t"))(run)


for _kind in _GEMM:
    _gemm(_kind)


@query("""
with p as (select vec_id, embedding::double[] as e from embeddings)
select vec_id, cast(r as int) as at, round(list_sum(list_transform(range(0, 64), lambda k: e[k + 1] * (((7 * r + 3 * k) % 11 - 5)::double / 10))) + r::double / 4, 4) as x from p, range(0, 16) t(r)""")
def projection(spark, sf_dir):
    at = np.arange(16)[:, None] * 7 + np.arange(64)[None, :] * 3
    made = linalg.projected(_embeddings(spark, sf_dir), (at % 11 - 5) / 10, np.arange(16) / 4)
    return made.select("vec_id", F.posexplode("projected").alias("at", "x")).withColumn("x", F.round("x", 4))


# A store made of the tables: five pages a document, a registry row for each of them.

_REGISTRY = """
select file as file_hash, 'folder/' || file || '.pdf' as file_path, case when cast(file as int) % 7 = 6 then 'failed' else 'done' end as status,
  case when cast(file as int) % 5 = 4 then '' else 'store/' || file end as embedding_path, cast(file as bigint) as ingest_seq
from (select distinct cast(vec_id // 50 as varchar) as file from embeddings where vec_id >= 40)"""


def _registry(embeddings: DataFrame) -> DataFrame:
    files = embeddings.where("vec_id >= 40").select(F.expr("cast(vec_id div 50 as string)").alias("file_hash")).distinct()
    return files.selectExpr(
        "file_hash", "'folder/' || file_hash || '.pdf' as file_path", "case when cast(file_hash as int) % 7 = 6 then 'failed' else 'done' end as status",
        "case when cast(file_hash as int) % 5 = 4 then '' else 'store/' || file_hash end as embedding_path", "cast(file_hash as bigint) as ingest_seq",
    )


def _stored_pages(embeddings: DataFrame) -> DataFrame:
    return _pages(embeddings).select(F.expr("cast(page div 5 as string)").alias("file_hash"), F.expr("cast(page % 5 as int) + 1").alias("page_number"), "vectors")


_SEARCH = """
with r as ({registry}), live as (select * from r where status = 'done' and coalesce(embedding_path, '') <> ''),
p as (select cast(vec_id // 50 as varchar) as file_hash, cast((vec_id // 10) % 5 as int) + 1 as page_number, embedding::double[] as e from embeddings where vec_id >= 40),
q as (select vec_id as i, embedding::double[] as e from embeddings where vec_id < 4),
best as (select file_hash, page_number, i, max(list_dot_product(q.e, p.e)) as m from p, q group by all),
scored as (select file_hash, page_number, round(sum(m), 4) as score from best group by all),
pages as (select *, cast(count(*) over (partition by file_hash) as int) as total_pages from scored)
select score, file_path, regexp_extract(file_path, '([^/]*)$', 1) as filename, file_hash, page_number, total_pages
from pages join live using (file_hash)
order by score desc, ingest_seq, page_number limit {k}"""


@query(_SEARCH.format(registry=_REGISTRY, k=10))
def search_topk(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    reg = _registry(e)
    packed = _stored_pages(e).select("file_hash", "page_number", F.flatten("vectors").alias("flat"))
    return search.rank_hits(reg, scoring.score_packed(packed, _query(e, "vec_id < 4"), ["file_hash", "page_number"]), packed, 10, digits=4)


@query(_SEARCH.format(registry=_REGISTRY, k=10))
def search_bounded(spark, sf_dir):
    """The same hits, from pages that are scored in the order of the bounds of their envelopes until no other can be better."""
    e = _embeddings(spark, sf_dir)
    reg = _registry(e)
    packed = _stored_pages(e).select("file_hash", "page_number", F.lit(64).alias("dim"), F.flatten("vectors").alias("flat"))
    packed = scoring.packed_bytes(packed.join(search.searchable(reg).select("file_hash"), "file_hash", "left_semi"))
    keys = ["file_hash", "page_number"]
    scored, _ = search.best_pages(packed, search.enveloped(packed, keys), np.array(_query(e, "vec_id < 4")), keys, 10, [], first=1, growth=2)
    return search.rank_hits(reg, scored, packed, 10, digits=4)


@query(f"""
with r as ({_REGISTRY}), live as (select * from r where status = 'done' and coalesce(embedding_path, '') <> ''),
p as (select cast(vec_id // 50 as varchar) as file_hash, cast((vec_id // 10) % 5 as int) + 1 as page_number, embedding::double[] as e from embeddings where vec_id >= 40),
q as (select vec_id // 4 as query_id, vec_id as i, embedding::double[] as e from embeddings where vec_id < 40),
best as (select query_id, file_hash, page_number, i, max(list_dot_product(q.e, p.e)) as m from p, q group by all),
scored as (select query_id, file_hash, page_number, round(sum(m), 4) as score from best group by all),
pages as (select *, cast(count(*) over (partition by query_id, file_hash) as int) as total_pages from scored),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, ingest_seq, page_number) as int) as rank from pages join live using (file_hash))
select query_id, rank, score, file_path, file_hash, page_number, total_pages from ranked where rank <= 3""")
def search_many(spark, sf_dir):
    """Ten queries at once, with one scan of the pages."""
    e = _embeddings(spark, sf_dir)
    queries = scoring.pack_pages(e.where("vec_id < 40").withColumn("query_id", F.expr("vec_id div 4")), ["query_id"]).withColumnRenamed("vectors", "query_vectors")
    packed = _stored_pages(e).select("file_hash", "page_number", F.flatten("vectors").alias("flat"))
    return search.search_many(queries, _registry(e), packed, 3, digits=4).drop("filename")


@query("with r as (" + _REGISTRY + ") select file_hash, file_path, embedding_path from r where status = 'done' and coalesce(embedding_path, '') <> ''")
def search_done_only(spark, sf_dir):
    return search.searchable(_registry(_embeddings(spark, sf_dir))).select("file_hash", "file_path", "embedding_path")


_LOG = """
select event_id as seq, cast(user_id as varchar) as file_hash, 'path/' || user_id || '/' || event_id as file_path,
  case event_type when 'click' then 'processing' when 'purchase' then 'done' when 'error' then 'failed' else 'pending' end as op
from events"""

_FOLD = f"""
with log as ({_LOG}),
a as (select *, coalesce(max(case when op <> 'failed' then 1 else 0 end) over (partition by file_hash order by seq rows between unbounded preceding and 1 preceding), 0) as existed from log),
b as (select *, op in ('processing', 'done') or (op = 'failed' and existed = 1) or (op = 'pending' and existed = 0) as effective from a),
registry as (
  select file_hash, max_by(op, seq) filter (effective) as status, min(seq) filter (op <> 'failed') as ingest_seq from b group by file_hash having count(*) filter (effective) > 0
)"""


def _log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as seq", "case event_type when 'click' then 'processing' when 'purchase' then 'done' when 'error' then 'failed' else 'pending' end as op",
        "cast(user_id as string) as file_hash", "'path/' || user_id || '/' || event_id as file_path", "1 as num_pages", "'store/' || user_id as embedding_path",
        "'broken' as error_message", "cast(null as timestamp) as at",
    )


@query(_FOLD + " select file_hash, status, ingest_seq from registry")
def registry_latest(spark, sf_dir):
    return registry.registry_of(_log(spark, sf_dir)).select("file_hash", "status", "ingest_seq")


@query(_FOLD + " select file_hash, case when status = 'processing' then 'pending' else status end as status from registry")
def registry_reset(spark, sf_dir):
    return registry.reset_in_progress(registry.registry_of(_log(spark, sf_dir))).select("file_hash", "status")


@query(_FOLD + " select count(*) as total_documents, count(*) filter (status = 'done') as indexed_documents from registry")
def registry_status(spark, sf_dir):
    return registry.status_counts(registry.registry_of(_log(spark, sf_dir)))


@query(_FOLD + " select file_hash, status, ingest_seq from registry where file_hash = '17'")
def registry_lookup_hash(spark, sf_dir):
    return registry.registry_of(_log(spark, sf_dir).where("file_hash = '17'")).select("file_hash", "status", "ingest_seq")


@query("with r as (" + _REGISTRY + ") select file_hash, file_path from r where file_path = 'folder/3.pdf'")
def registry_lookup_path(spark, sf_dir):
    same = texts.normal_path_column(F.concat(F.lit("./x/../"), F.col("file_path"))) == texts.normal_path("folder//3.pdf")
    return _registry(_embeddings(spark, sf_dir)).where(same).orderBy("ingest_seq").limit(1).select("file_hash", "file_path")


@query("with r as (" + _REGISTRY + ") select file_hash, file_path from r where file_hash <> '3'")
def registry_delete(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    log = _registry(e).selectExpr(
        "ingest_seq as seq", "'done' as op", "file_hash", "file_path", "5 as num_pages", "embedding_path", "cast(null as string) as error_message", "cast(null as timestamp) as at"
    )
    gone = log.where("file_hash = '3'").withColumn("op", F.lit("delete")).withColumn("seq", F.lit(1_000_000).cast("long"))
    return registry.registry_of(log.unionByName(gone)).select("file_hash", "file_path")


@query("with r as (" + _REGISTRY + ") select file_hash, file_path from r where cast(file_hash as int) % 2 = 0")
def sync_deleted(spark, sf_dir):
    r = _registry(_embeddings(spark, sf_dir))
    return registry.without_stale(r, r.where("cast(file_hash as int) % 2 = 0").select("file_path")).select("file_hash", "file_path")


@query("with r as (" + _REGISTRY + """)
select file_hash, case when cast(file_hash as int) % 3 = 0 then 'done' else status end as status, case when cast(file_hash as int) % 3 = 0 then 'store#second' else 'store#first' end as embedding_path,
  case when cast(file_hash as int) % 3 <> 0 and status = 'failed' then 'broken' end as error_message, cast(case when cast(file_hash as int) % 3 = 0 then 7 else 5 end as int) as num_pages from r""")
def delete_and_reingest(spark, sf_dir):
    """All documents are done, some fail later and keep what the first success stored; every third is deleted and ingested
    again, under another attempt.  As the library's own registry says it."""
    own = registry.Registry(spark, f"{shared_root(ship(spark))}/registry-{uuid.uuid4().hex}")
    r = _registry(_embeddings(spark, sf_dir)).selectExpr("ingest_seq as seq", "file_hash", "file_path", "status")
    third = r.where("cast(file_hash as int) % 3 = 0")
    own.append(r.selectExpr("seq", "'done' as op", "file_hash", "file_path", "5 as num_pages", "'store#first' as embedding_path"))
    own.append(r.where("status = 'failed'").selectExpr("seq", "'failed' as op", "file_hash", "file_path", "'broken' as error_message"))
    own.delete(third)
    own.append(third.selectExpr("seq", "'done' as op", "file_hash", "file_path", "7 as num_pages", "'store#second' as embedding_path"))
    return own.table().select("file_hash", "status", "embedding_path", "error_message", "num_pages")


@query(_FOLD + " select file_hash, status, ingest_seq from registry")
def registry_incremental(spark, sf_dir):
    """All events, appended in twelve stretches; the log is merged and reduced as it grows."""
    own = registry.Registry(spark, f"{shared_root(ship(spark))}/registry-{uuid.uuid4().hex}")
    own.MERGE = 4
    log = _log(spark, sf_dir)
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    step = (high - low) // 12 + 1
    for k in range(12):
        own.append(log.where(F.col("seq").between(low + k * step, low + (k + 1) * step - 1)).withColumn("seq", F.col("seq") - F.lit(low + k * step)))
    inserting = own.log().where("op <> 'failed'")  # a failure before the first insertion gives no place
    held = inserting.groupBy("file_hash").agg(F.min_by("file_path", "seq").alias("first"))  # paths name their events
    first = F.substring_index("first", "/", -1).cast("long")
    return own.table().join(held, "file_hash").select("file_hash", "status", first.alias("ingest_seq"))


@query("""
select 'folder/' || doc_id || '.pdf' as file_path, case doc_id % 4 when 1 then 'created' when 2 then 'deleted' else 'modified' end as change from documents where doc_id % 4 <> 0""")
def listing_changes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = docs.where("doc_id % 4 <> 1").selectExpr("'folder/' || doc_id || '.pdf' as file_path", "0 as modified", "n_chars as length")
    now = docs.where("doc_id % 4 <> 2").selectExpr("'folder/' || doc_id || '.pdf' as file_path", "cast(doc_id % 4 = 3 as int) as modified", "n_chars as length")
    return watch.changes(before, now).select("file_path", "change")


@query("""
with files as (select sha256(text) as file_hash, source || '/' || lpad(cast(doc_id as varchar), 12, '0') || '.pdf' as file_path, doc_id from documents where text is not null),
done as (select file_hash from files group by file_hash having min(doc_id) % 3 = 0)
select file_hash, min(file_path) as file_path from files where file_hash not in (select file_hash from done) group by file_hash""")
def new_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    files = docs.select(F.sha2("text", 256).alias("file_hash"), F.expr("source || '/' || lpad(cast(doc_id as string), 12, '0') || '.pdf'").alias("file_path"), "doc_id")
    known = files.groupBy("file_hash").agg(F.min("doc_id").alias("first")).selectExpr("file_hash", "case when first % 3 = 0 then 'done' else 'failed' end as status")
    return ingestion.new_documents(files, known).select("file_hash", "file_path")


@query("select sha256(text) as file_hash, min(source || '/' || lpad(cast(doc_id as varchar), 12, '0') || '.pdf') as file_path from documents where text is not null group by 1")
def content_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    files = docs.select(F.sha2("text", 256).alias("file_hash"), F.expr("source || '/' || lpad(cast(doc_id as string), 12, '0') || '.pdf'").alias("file_path"))
    nothing_done = spark.createDataFrame([], REGISTRY)
    return ingestion.new_documents(files, nothing_done).select("file_hash", "file_path")


@query("""
with d as (select doc_id, cast(ceil(n_chars / 500.0) as int) as num_pages from documents)
select doc_id, cast(s as int) as chunk_start, cast(least(s + 8, num_pages) as int) as chunk_end from (select *, unnest(range(0, num_pages, 8)) as s from d)""")
def chunk_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(ceil(n_chars / 500.0D) as int) as num_pages")
    return store.page_chunks(docs).select("doc_id", "chunk_start", "chunk_end")


@query("""
with d as (select doc_id, cast(ceil(n_chars / 500.0) as int) as num_pages, cast(doc_id % 12 as int) as page_number from documents)
select doc_id, page_number, page_number between 1 and num_pages as in_range from d""")
def page_bounds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(ceil(n_chars / 500.0D) as int) as num_pages", "cast(doc_id % 12 as int) as page_number")
    return docs.select("doc_id", "page_number", store.page_in_range("page_number", "num_pages").alias("in_range"))


@query(r"""
with t as (select conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') as x from conversations where role = 'user'),
u as (select conv_id, turn, case when starts_with(x, 'Question:') then x else 'Question: ' || x end as x from t)
select conv_id, turn, case when ends_with(x, '<end_of_utterance>') then x else x || '<end_of_utterance>' end as query from u""")
def format_query(spark, sf_dir):
    user = table(spark, sf_dir, "conversations").where("role = 'user'")
    return user.select("conv_id", "turn", texts.format_query(F.col("text")).alias("query"))


@query("""
select conv_id, turn, case when starts_with(x, '<|im_start|>') then x else '<|im_start|>User:<image>' || x || '<end_of_utterance>' end as prompt
from (select conv_id, turn, case when conv_id % 2 = 0 then '<|im_start|>' || text else text end as x from conversations)""")
def format_prompt(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("x", F.expr("case when conv_id % 2 = 0 then '<|im_start|>' || text else text end"))
    return rows.select("conv_id", "turn", texts.format_prompt(F.col("x")).alias("prompt"))


_TOKENS = r"""
words as (select {id}, list_filter(string_split_regex(regexp_replace({text}, '^\s+|\s+$', '', 'g'), '\s+'), lambda w: w <> '') as ws from {source}),
tokens as (select {id}, generate_subscripts(ws, 1) - 1 as token_idx, unnest(ws) as word from words),
n as (select count(*) as n from embeddings),
placed as (select {id}, token_idx, cast('0x' || substr(md5(word), 1, 8) as bigint) % n.n as row from tokens, n)"""


@query("with " + _TOKENS.format(id="conv_id, turn", text="text", source="conversations where role = 'user'") + " select conv_id, turn, cast(token_idx as int) as token_idx, row from placed")
def encode_text(spark, sf_dir):
    user = table(spark, sf_dir, "conversations").where("role = 'user'")
    n = table(spark, sf_dir, "embeddings").count()
    tokens = user.select("conv_id", "turn", F.posexplode(encoding.words_of(F.col("text"))).alias("token_idx", "word"))
    return tokens.select("conv_id", "turn", "token_idx", encoding.codebook_row(F.col("word"), n).alias("row"))


_QUERY_WORDS = "of the and that with this from what"

#: Rows of a codebook whose products are sent to all executors at most.
CODEBOOK_SENT = 1_000_000


@query(
    "with " + _TOKENS.format(id="doc_id", text="text", source="documents")
    + f""",
q as (select row_number() over () as i, cast('0x' || substr(md5(w), 1, 8) as bigint) % n.n as row from (select unnest(string_split('{_QUERY_WORDS}', ' ')) as w), n),
sims as (select b.vec_id as row, q.i, list_dot_product(b.embedding::double[], c.embedding::double[]) as s from embeddings b, q join embeddings c on c.vec_id = q.row),
best as (select doc_id, i, max(s) as m from (select distinct doc_id, row from placed) join sims using (row) group by doc_id, i),
scored as (select doc_id, round(sum(m), 4) as score from best group by doc_id)
select doc_id, score from scored order by score desc, doc_id limit 10"""
)
def search_text(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    n = e.count()
    docs = table(spark, sf_dir, "documents")
    # a shared codebook: products are taken once per codebook row and query word, not once per word of the corpus
    words = spark.range(1).select(F.posexplode(F.split(F.lit(_QUERY_WORDS), " ")).alias("i", "word")).withColumn("q", encoding.codebook_row(F.col("word"), n))
    asked = words.join(e.select(F.col("vec_id").alias("q"), F.col("vec").alias("qv")), "q").agg(F.array_sort(F.collect_list(F.struct("i", "qv"))).alias("qs"))
    sims = e.crossJoin(asked).select(F.col("vec_id").alias("row"), F.transform("qs", lambda q: V.dot(q["qv"], F.col("vec"))).alias("sims"))  # asked is one row
    tokens = docs.select("doc_id", F.explode(F.array_distinct(encoding.words_of(F.col("text")))).alias("word"))
    placed = tokens.select("doc_id", encoding.codebook_row(F.col("word"), n).alias("row"))
    k = len(_QUERY_WORDS.split())
    # by their rows the words of a document part, and a task meets all documents; so products go to the words, or words go home
    joined = placed.join(F.broadcast(sims), "row") if n <= CODEBOOK_SENT else placed.join(sims, "row").repartition("doc_id")
    best = joined.groupBy("doc_id").agg(*[F.max(F.col("sims")[i]).alias(f"m{i}") for i in range(k)])
    score = sum((F.col(f"m{i}") for i in range(1, k)), F.col("m0"))
    return best.select("doc_id", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query("with hits as (" + _SEARCH.format(registry=_REGISTRY, k=10) + """)
select file_hash, page_number, cast(row_number() over (order by score desc, file_path, page_number) as int) as rank,
  '[Document Page ' || row_number() over (order by score desc, file_path, page_number) || ' | File: ' || filename || ' | Page: ' || page_number || ']' as label from hits""")
def answer_labels(spark, sf_dir):
    return answering.labelled(search_topk(spark, sf_dir)).select("file_hash", "page_number", "rank", "label")


@query("""
select conv_id, turn, case when n_hits = 0 then 'no_results' when length(trim(coalesce(key, ''))) = 0 or n_images = 0 or answer is null then 'fallback_pages_only' else 'success' end as status
from (select conv_id, turn, conv_id % 4 as n_hits, case when turn % 3 = 0 then ' ' else 'key' end as key, conv_id % 3 as n_images, nullif(turn % 5, 4) as answer from conversations)""")
def answer_outcome(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "conv_id % 4 as n_hits", "case when turn % 3 = 0 then ' ' else 'key' end as key", "conv_id % 3 as n_images", "nullif(turn % 5, 4) as answer"
    )
    return rows.select("conv_id", "turn", answering.outcome(F.col("n_hits"), F.col("key"), F.col("n_images"), F.col("answer")).alias("status"))


@query("select parse_filename(filename) as filename, sha256(content) as file_hash from read_blob('/root/testdata/sf0.01/*.parquet')")
def stream_ingest(spark, sf_dir):
    """The stream of changes over the files of the tables, read to its end; only files that came are hashed.  The SQL reads
    the files of ``sf0.01``, as a view has none."""
    folder = f"{shared_root(spark)}/watch-{uuid.uuid4().hex}"
    stream = watch.changed_files(ship(spark), sf_dir, f"{folder}/listings", "*.parquet", recursive=True, settle=False)

    def handle(come: DataFrame, gone: DataFrame) -> None:
        folders.hashed(come).select(texts.basename(F.col("file_path")).alias("filename"), "file_hash").write.mode("append").parquet(f"{folder}/out")

    watch.start(stream, f"{folder}/stream", handle).awaitTermination()
    return spark.read.schema("filename string, file_hash string").parquet(f"{folder}/out")


@query("""
select 'src/' || coalesce(source, '') || '/' || doc_id || '.txt' as file_path, octet_length(encode(text)) as length, sha256(text) as file_hash from documents where text <> ''""")
def folder_hashes(spark, sf_dir):
    """Every text as a file of a folder per source, listed and hashed by the folder source; empty files are not listed."""
    folder = f"{shared_root(spark)}/files-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    sink.save_files(docs.selectExpr("'src/' || coalesce(source, '') || '/' || doc_id || '.txt' as name", "cast(text as binary) as content"), folder)
    found = files.documents(spark, folder, "*.txt")
    return found.select(F.substring_index("file_path", f"{folder.rsplit('/', 1)[1]}/", -1).alias("file_path"), "length", "file_hash")


_PAGE_WORDS, _LINE_WORDS = 240, 12


@query(f"""
with w as (select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from documents where text is not null),
p as (select doc_id, words, cast(ceil(len(words) / {_PAGE_WORDS}.0) as int) as num_pages, unnest(range(0, len(words), {_PAGE_WORDS})) as first from w),
t as (select doc_id, num_pages, cast(first / {_PAGE_WORDS} + 1 as int) as page_number, array_to_string(words[first + 1:first + {_PAGE_WORDS}], ' ') as text from p)
select doc_id, page_number, num_pages, cast(length(text) as bigint) as n_chars, sha256(text) as text_hash from t""")
def pdf_pages(spark, sf_dir):
    """Every text as a PDF file of pages of 240 words; the files are listed, their pages counted and read by ranges of
    eight, each range by its path.  Odd documents have their objects in the open, even ones in object streams."""
    folder = f"{shared_root(spark)}/pdf-{uuid.uuid4().hex}"
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = lambda of, by: F.transform(F.sequence(F.lit(0), F.size(of) - 1, F.lit(by)), lambda at: F.slice(of, at + 1, by))
    page = lambda part: F.array_join(F.transform(cut(part, _LINE_WORDS), lambda line: F.array_join(line, " ")), "\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(folders.spread_over(spark), "doc_id")  # few row groups hold much work
    docs = docs.select("doc_id", words.alias("words")).where(F.size("words") > 0)
    docs = docs.select("doc_id", F.transform(cut(F.col("words"), _PAGE_WORDS), page).alias("pages"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pages = (c.to_pylist() for c in batch.columns)
            content = [pdf.written(p, i % 2 == 0) for i, p in zip(ids, pages, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.pdf" for i in ids]), pa.array(content, pa.binary())], names=["name", "content"])

    sink.save_files(docs.mapInArrow(made, sink.FILES), folder)
    found = files.listing(spark, folder).select("file_path", F.lit("").alias("file_hash"))
    reader = ingestion.DocumentPages()
    pages = ingestion.rendered(ingestion.counted(found, reader), reader)
    text = F.regexp_replace("content", "\n", " ")
    doc_id = F.regexp_extract("file_path", r"(\d+)\.pdf$", 1).cast("long")
    return pages.select(doc_id.alias("doc_id"), "page_number", "num_pages", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_hash"))


@query("""
select vec_id // 50 as file, cast(vec_id % 50 + 1 as int) as page_number, cast(1 as int) as n_tokens, cast(len(embedding) as int) as dim,
round(list_sum([cast(x as double) for x in embedding]), 3) as total from embeddings""")
def npy_round_trip(spark, sf_dir):
    """Vectors as ``.npy`` files of fifty pages of one vector, written by the file sink and read back."""
    folder = f"{shared_root(spark)}/npy-{uuid.uuid4().hex}"
    pages = _embeddings(spark, sf_dir).selectExpr(
        "cast(vec_id div 50 as string) as file_hash", "cast(vec_id % 50 + 1 as int) as page_number", "1 as n_tokens", "size(vec) as dim", "vec as flat"
    )
    sink.save_files(sink.npy_files(scoring.packed_bytes(pages)), folder)
    back = files.npy_embeddings(spark, folder)

    @F.pandas_udf("double")
    def total(flat: pd.Series) -> pd.Series:
        return pd.Series([float(np.frombuffer(x, "<f4").astype(float).sum()) for x in flat])

    return back.select(F.col("file_hash").cast("long").alias("file"), "page_number", "n_tokens", "dim", F.round(total("flat"), 3).alias("total"))
