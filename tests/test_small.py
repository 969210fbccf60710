"""Small operators by example: diverging names, keys as text, and authored types that callsites don't support."""

import json

from pyspark.sql import functions as F

from rulelake.functions import names
from rulelake.operators import catalog, depgraph, reports
from rulelake.sources.session import layer_of


def test_diverging_names(spark):
    rows = [("Foo", "b.Foo", 1, 0), ("Foo", "a.Foo", 0, 5), ("Foo", "b.Foo", 0, 9), ("Bar", "a.Bar", 0, 0), (None, "x", 0, 0), (None, "y", 1, 0)]
    usage = spark.createDataFrame(rows, "raw string, name string, prod_ord int, pos int")
    assert {(r.raw, r.n, r.kept) for r in depgraph.divergent(usage).collect()} == {("Foo", 2, "a.Foo"), (None, 2, "x")}
    assert depgraph.divergent(usage.limit(0)).collect() == []


def test_keys_and_paths(spark):
    row = spark.range(1).select(catalog.text_keys(F.create_map(F.lit(":a/b"), F.lit(1), F.lit("c"), F.lit(2))).alias("m"), names.resource_path(F.lit("my-app.core-x")).alias("p")).first()
    assert row.m == {"a/b": 1, "c": 2} and row.p == "my_app/core_x"


def test_types_without_callsites(spark):
    """Only types of a dimension with callsites are at stake, and only those that no callsite has."""
    site = {"source-str": "(f)", "ns-name-sym": "a", "status": "full", "resolved-types": json.dumps(["A"])}
    detected = {"dynamic-insert-types-detected": {"callsites": [site]}}
    e = layer_of(spark, {"a/r": {"insert-types": ["A", "B"], "retract-types": ["C"], **detected}, "a/s": {"insert-types": ["D"]}}, "l", 1)
    found = reports.derivation_drops(e).collect()
    assert [(r.rule, r.layer, r.dim, r.message) for r in found] == [("a/r", "l", "insert", "authored type B has no callsite to support it")]
    assert reports.derivation_drops(e.limit(0)).collect() == []
