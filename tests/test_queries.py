"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from rulelake.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, sf, duck, name):
    got = Q.queries()[name](spark, sf)
    want = duck.sql(Q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a, b = plain(tuple(r[c] for c in cols) for r in got.collect()), plain(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert len(a) == len(b) and a == b


def test_route_ids(spark):
    import hashlib

    from pyspark.sql import functions as F

    from rulelake.functions import names

    for r in spark.createDataFrame([("a.b/c d",), ("x",), (":k/é",)], "n string").select("n", names.base36(F.sha1(F.encode("n", "UTF-8"))).alias("b")).collect():
        n, out = int(hashlib.sha1(r.n.encode()).hexdigest(), 16), ""
        while n:
            n, d = divmod(n, 36)
            out = names.BASE36[d] + out
        assert r.b == out


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries()) and os.path.exists(e.__file__)


def test_cycles_end(spark):
    from rulelake.operators import hierarchy

    got = hierarchy.closure(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "t string, p string"), "t", "p")
    assert {tuple(r) for r in got.collect()} == {(x, y) for x in "ab" for y in "abc"}
    order = hierarchy.ordered_ancestors(spark.createDataFrame([("x", "a"), ("x", "b"), ("b", "a"), ("x", "c")], "type string, ancestor string"))
    assert {r.type: r.ancestors for r in order.collect()}["x"] == ["b", "a", "c"]
