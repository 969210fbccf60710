"""What nodes hold, canonical values, names in order, and the tree of all answers."""

from pyspark.sql import functions as F

from rulelake import engine as E
from rulelake.operators import catalog, memory
from rulelake.sources import session as S
from tests.test_rulebase import shop  # noqa: F401


def test_canonical_values(spark):
    same = [('{"b":1,"a":[1.50,{"d":null,"c":"x"}]}', '{ "a": [1.5, {"c":"x","d":null}], "b": 1.0 }'), ('"\\u00e9"', '"é"'), ("[1,2]", "[1, 2]")]
    rows = spark.createDataFrame(same, "a string, b string").select(memory.canonical(F.col("a")).alias("a"), memory.canonical(F.col("b")).alias("b"))
    assert all(r.a == r.b for r in rows.collect()) and "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    odd = ["not json", "", None, '{"a":1,"a":2}', "[2,1]"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in odd], "x string").select(memory.canonical(F.col("x"))).collect()] == odd


def test_names_in_order(spark):
    rows = spark.createDataFrame([(x,) for x in ("b", "A", "a", "É", "e", "f", "B", "ab", None)], "name string")
    assert [r.name for r in catalog.by_name(rows).collect()] == ["a", "A", "ab", "b", "B", "e", "É", "f", None]


def test_node_memories(spark, shop):  # noqa: F811
    elements = spark.createDataFrame([("1", 10, '{"?id": 1, "?a": 2}'), ("1", 10, '{"?a":2,"?id":1}'), ("1", 11, None), ("2", 10, "{}"), ("1", 99, "{}"), ("1", None, "{}")], S.SCHEMAS["elements"])
    tokens = spark.createDataFrame([("2", 5, 1, 11, "{}"), ("2", 5, 0, 10, "{}"), ("2", 6, None, None, None), ("2", 7, 0, 99, '{"?x": 1}')], S.SCHEMAS["tokens"])
    session = S.Session(spark, shop.tables | {"elements": elements, "tokens": tokens})
    e = E.Engine(session)
    ids = {r.uid: r.fact_id for r in e.analysis.memory.ids.collect()}
    assert [tuple(r) for r in e.get("/v1/session/elements/1").collect()] == sorted([("1", ids[10], '{"?a":2,"?id":1}', 2), ("1", ids[11], None, 1)], key=lambda r: r[1])
    assert [tuple(r) for r in e.get("/v1/session/tokens/2").collect()] == [("2", 5, [ids[10], ids[11]], "{}"), ("2", 6, [], None), ("2", 7, [None], '{"?x":1}')]
    assert E.Engine(shop).get("/v1/session/elements/1").collect() == [] and E.Engine(shop).get("/v1/session/tokens/9").collect() == []


def test_tree_of_all_answers(spark, shop, tmp_path):  # noqa: F811
    e, root = E.Engine(shop), f"file://{tmp_path}/tree"
    e.export(root)
    a = e.analysis
    for resource, rows in (("rules", a.summaries.filter("kind = 'rule'")), ("fact-types", a.types.drop("place")), ("session/facts", a.session_facts)):
        back = S.read_export(spark, root, resource, rows.schema)
        assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect())) and back.count()
    ident = a.summaries.filter("name = 'shop.rules/bill'").first()["id"]
    found = S.read_export(spark, root, "session/rules", "prod string, what string, place long, id string").filter(F.col("id") == ident)
    assert found.count() == e.activity("rule", ident).count() > 0
    for route in (f"/v1/rules/{ident}", "/v1/rulebase-summary", "/v1/session/facts/1"):
        assert S.exists(spark, S.export_location(route, root)), route
    assert S.read_export(spark, root, "rulebase-summary", "`rule-count` long").first()["rule-count"] == 4
    S.write_export({}, f"{root}/none")
