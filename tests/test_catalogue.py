"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from latewing.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "customer documents embeddings events conversations labels lineitem nation orders pages part region supplier benchmark".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    made = catalogue.QUERIES[name](spark, str(DATA)).toPandas()
    if name in catalogue.SQL:
        want = duck.execute(catalogue.SQL[name].replace("/root/testdata/sf0.01/", f"{DATA}/")).df()  # one reads files by their path
        assert sorted(made.columns) == sorted(want.columns)
        assert plain(made) == plain(want)
    else:
        assert len(made) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_failure_before_the_first_insertion_gives_no_place(spark, tmp_path):
    c = duckdb.connect()
    kinds = "case when i = 0 then 'error' when i = 30 then 'click' else 'view' end"
    c.execute(f"create table events as select i as event_id, i % 3 as user_id, {kinds} as event_type from range(0, 60) t(i)")
    c.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    made = catalogue.QUERIES["registry_incremental"](spark, str(tmp_path)).toPandas()
    assert plain(made) == plain(c.execute(catalogue.SQL["registry_incremental"]).df())


def test_words_stay_with_their_documents(spark, monkeypatch):
    made = catalogue.search_text(spark, str(DATA))
    assert "hashpartitioning(row#" not in made._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(catalogue, "CODEBOOK_SENT", 0)
    by_shuffle = catalogue.search_text(spark, str(DATA))
    assert plain(made.toPandas()) == plain(by_shuffle.toPandas())
