"""Corpus queries with SQL give the rows that DuckDB gives, over the whole small tables."""

import duckdb
import pytest

from rulelake.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want, got = c.sql(Q.oracle_sql()[name]), Q.queries()[name](spark, sf)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = sorted(tuple(r) for r in got.select(*cols).collect())
    assert rows and rows == sorted(want.project(", ".join(cols)).fetchall())
