"""Every query with SQL against DuckDB, over whole tables of the smallest size."""

from __future__ import annotations

import math

import duckdb
import pytest

from quillspark.plans import alignment_queries, box_queries, change_queries, domain_queries, drawing_queries, history_queries, page_queries, pairing_queries, queries, reply_queries, review_queries, rollup_queries, search_queries, text_check_queries, text_queries, timer_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return float(value) if isinstance(value, int) else str(value)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, small, duck, name):
    got = queries.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
