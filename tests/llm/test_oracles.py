"""Corpus queries with SQL against DuckDB, over whole tables of the smallest size."""

from __future__ import annotations

import duckdb
import pytest

from quillspark.llm import queries
from quillspark.llm.oracles import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, small), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    assert rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
