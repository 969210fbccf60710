"""A small rulebase with its session, through all relations: extraction, graph, types, memory, layers, engine and command line."""

import json

import pytest
from pyspark.sql import functions as F

from rulelake import cli
from rulelake import engine as E
from rulelake.functions import names
from rulelake.operators import annotations as A
from rulelake.operators import catalog, extract, nodes
from rulelake.sources import session as S

ORDER, RUSH, PAID, BILL, NOTE = "shop.Order", "shop.RushOrder", "shop.Paid", "shop.Bill", ":shop/note"
LHS = {
    "shop.rules/bill": [{"type": ORDER, "constraints": "[(= ?id id)]", "fact-binding": "?order"}, ["not", {"type": PAID, "constraints": "[(= ?id id)]"}]],
    "shop.rules/pay": [{"type": BILL, "args": "[{:keys [id]}]", "constraints": ["(= ?id id)"]}, {"constraints": ["(pos? ?id)"]}],
    "shop.rules/remind": [{"accumulator": ["acc/all"], "from": {"type": BILL}, "result-binding": "?bills"}, ["or", {"type": ORDER}, {"type": NOTE}]],
    "shop.rules/idle": [],
    "shop.rules/all-bills": [{"type": BILL, "fact-binding": "?b"}],
}
PROPS = {"shop.rules/bill": {"insert-types": json.dumps([BILL])}, "shop.rules/remind": {"insert-types": json.dumps([NOTE]), "retract-types": json.dumps([PAID])}}


@pytest.fixture(scope="module")
def shop(spark):
    t = lambda rows, name: spark.createDataFrame(rows, S.SCHEMAS[name])
    productions = [(i, n, None if n.endswith("all-bills") else "shop.rules", "query" if n.endswith("all-bills") else "rule", None, PROPS.get(n, {}), ["?id"] if n.endswith("all-bills") else None, json.dumps(lhs), "(do (insert! (->Paid ?id)))" if n.endswith("pay") else "(do nil)") for i, (n, lhs) in enumerate(LHS.items())]
    facts = [(10, RUSH, "shop", '{"id": 2}', True), (11, BILL, "shop", '{"id":2, "a": 1}', False), (12, BILL, "shop", '{"a":1,"id":2}', False), (13, None, None, "5", True), (14, PAID, "shop", '{"id": 9}', False)]
    return S.Session(
        spark,
        {
            "productions": t(productions, "productions"),
            "ancestors": t([(RUSH, ORDER), (ORDER, "java.lang.Object"), (BILL, "java.lang.Object")], "ancestors"),
            "facts": t(facts, "facts"),
            "activations": t([(1, "shop.rules/bill", '{"?id":2}'), (2, "shop.rules/bill", '{"?id":3}'), (3, "shop.rules/all-bills", '{"?b":1,"?id":2}'), (4, "shop.rules/remind", "{}")], "activations"),
            "matches": t([(1, 10, None), (1, 10, None), (2, 10, None), (3, 11, None), (4, None, [11, 12]), (4, 10, [])], "matches"),
            "insertions": t([(1, "shop.rules/bill", 11), (2, "shop.rules/remind", 12), (3, "shop.rules/bill", 11), (4, "shop.rules/pay", 14)], "insertions"),
            "nodes": t([("1", "alpha", ["2"], None, None), ("2", "root-join", ["3", "4"], None, None), ("3", "production", [], "shop.rules/bill", None), ("4", "query", [], "shop.rules/all-bills", None)], "nodes"),
        },
    )


@pytest.fixture(scope="module")
def engine(shop):
    return E.Engine(shop)


def ident(spark, name):
    return spark.range(1).select(names.route_id(F.lit(name)).alias("i")).first()["i"]


def test_conditions_types_and_bindings(shop):
    c = extract.conditions(shop["productions"])
    assert [r.op for r in c.filter("prod = 'shop.rules/bill'").orderBy("pos").collect()] == ["fact", "not", "fact"]
    read = {(r.prod.split("/")[1], r.type) for r in extract.read_types(c).collect()}
    assert read == {("bill", ORDER), ("bill", PAID), ("pay", BILL), ("remind", BILL), ("remind", ORDER), ("remind", NOTE), ("all-bills", BILL)}
    assert {tuple(r)[1:] for r in extract.bindings(c).collect()} == {("?order", ORDER), ("?bills", BILL), ("?b", BILL)}
    assert extract.lhs_forms(shop["productions"]).filter("name = 'shop.rules/remind'").first().lhs_form == "[?bills <- (acc/all) :from [shop.Bill]]\n[:or [shop.Order] [:shop/note]]"
    assert {(r.ns, tuple(r.rules)) for r in extract.rules_by_namespace(shop["productions"]).collect()} == {("shop.rules", ("shop.rules/bill", "shop.rules/idle", "shop.rules/pay", "shop.rules/remind"))}


def test_later_productions_with_a_name_win(shop):
    twice = shop["productions"].unionByName(shop["productions"].filter("name = 'shop.rules/bill'").withColumns({"prod_ord": F.lit(9), "doc": F.lit("new")}))
    row = extract.latest(twice).filter("name = 'shop.rules/bill'").first()
    assert row.doc == "new" and row.prod_ord == 0 and extract.latest(twice).count() == 5


def test_graph(engine, spark):
    rows = {r["name"].split("/")[1]: r for r in engine.analysis.summaries.collect()}
    side = lambda n, s: [x["name"].split("/")[1] for x in rows[n][s] or []]
    assert side("bill", "downstream") == ["all-bills", "pay", "remind"] and side("bill", "upstream") == ["remind"]
    assert rows["bill"]["upstream"][0]["match"][0]["via"] == "retract"
    assert side("remind", "downstream") == ["bill"]  # its own note is no edge
    assert rows["bill"]["sink"] is False and rows["remind"]["sink"] is False and rows["idle"]["source"] and rows["idle"]["unlinked"] and rows["pay"]["unlinked"]
    assert [t["name"] for t in rows["bill"]["lhs_types"]] == [ORDER, PAID] and rows["bill"]["id"] == ident(spark, "shop.rules/bill")
    assert [r["prod"].split("/")[1] for r in engine.analysis.unresolved.select("prod").collect()] == ["pay"]
    assert rows["all-bills"]["ns"] == "shop.rules"


def test_fact_types(engine):
    rows = {r["name"]: r for r in engine.analysis.types.collect()}
    assert [r["name"] for r in engine.fact_types().collect()] == [ORDER, PAID, BILL, NOTE, "java.lang.Object"]
    refs = lambda t, c: [x["name"].split("/")[1] for x in rows[t][c]]
    assert refs(BILL, "inserted_by_rules") == ["bill"] and refs(BILL, "used_by_queries") == ["all-bills"] and refs(BILL, "used_by_rules") == ["pay", "remind"]
    assert refs("java.lang.Object", "inserted_by_rules") == ["bill"] and [a["known"] for a in rows[BILL]["ancestors"]] == [False]
    assert rows[NOTE]["ns"] == "shop" and rows[BILL]["ns"] == "shop" and refs(PAID, "retracted_by_rules") == ["remind"]
    assert engine.summary() == {"rule-count": 4, "query-count": 1, "fact-type-count": 5, "working-memory-available": True}


def test_memory(engine, shop, spark):
    m = engine.analysis.memory
    facts = {r["uid"]: r for r in m.facts().collect()}
    # types on left sides come first, in their order; equal facts are told apart
    assert [facts[u]["id"] for u in (14, 11, 12, 13, 10)] == [1, 2, 3, 4, 5]
    assert [x["name"].split("/")[1] for x in facts[11]["inserted_from"]] == ["bill"] and [x["name"].split("/")[1] for x in facts[11]["used_by"]] == ["remind", "all-bills"]
    assert facts[13]["type"]["name"] == ":unknown/fact-type" and not facts[13]["type"]["known"] and facts[11]["type"]["known"] and facts[13]["is_root"]
    groups = [(r["type"], r["name"], r["facts"]) for r in m.groups().orderBy("type", "place").collect()]
    assert (RUSH, "Root Facts (External)", [5]) in groups and (BILL, "shop.rules/bill", [2]) in groups
    act = {(r["prod"].split("/")[1], r["fact_id"]): r["bindings"] for r in m.activity().collect()}
    assert act[("bill", 5)] == ['{"?id":2}', '{"?id":3}'] and ("remind", 3) in act and ("remind", 2) in act
    assert not m.restamped(spark.createDataFrame([(RUSH,)], "type string")).facts().filter("uid = 11").first()["type"]["known"]
    assert {(r["name"], r["count"]) for r in m.types().collect()} == {(RUSH, 1), (BILL, 2), (":unknown/fact-type", 1), (PAID, 1)}


def test_routes(engine, shop, spark):
    bill = ident(spark, "shop.rules/bill")
    assert engine.get(f"/v1/rules/{bill}").first()["name"] == "shop.rules/bill" and engine.get("/v1/rules").count() == 4 and engine.get("/v1/queries").count() == 1
    assert engine.get(f"/v1/fact-types/{ident(spark, BILL)}").first()["name"] == BILL
    assert engine.get("/v1/session/facts/2").first()["uid"] == 11
    rows = engine.get(f"/v1/session/rules/{bill}").collect()
    assert [(r["what"], r["fact"]["id"]) for r in rows] == [("inserted", 2), ("match", 5)]
    assert engine.get(f"/v1/session/fact-types/{ident(spark, BILL)}").first()["count"] == 2
    for bad in ("/v1/rules/shop.rules/bill", "/v1/nothing", f"/v1/queries/{bill}"):
        with pytest.raises(E.NotFound):
            engine.get(bad)
    with pytest.raises(E.NoWorkingMemory) as e:
        E.Engine(shop.rulebase()).get("/v1/session/fact-types")
    assert e.value.reason == "rulebase-input"
    with pytest.raises(E.NoWorkingMemory) as e:
        E.Engine(shop, working_memory=False).get("/v1/memory-analysis")
    assert e.value.reason == "disabled-by-config" and e.value.status == 409


def test_annotations_from_memory(shop, spark):
    e = E.Engine(shop, {"source": {"shop.rules/idle": {"no-output-types": True}}, "enrichment": "auto-detect-from-memory"})
    pay = json.loads(e.annotations().filter("rule = 'shop.rules/pay'").first()["annotation"])
    assert pay["insert-types"] == [PAID]
    rows = {r["name"].split("/")[1]: r for r in e.rules().collect()}
    assert not rows["pay"]["unlinked"] and not rows["idle"]["unlinked"] and rows["remind"]["insert_types"][1]["name"] == BILL
    before = e.state
    e.reload()
    assert e.state is not before and e.state.session is shop
    e.swap()
    assert {r["name"].split("/")[1] for r in e.rules().filter("unlinked").collect()} == {"pay", "idle"}
    e.swap(spec={"enrichment": "reuse"})
    with pytest.raises(ValueError):
        e.swap(spec={"enrichment": "guess"})
    e.stop()
    with pytest.raises(RuntimeError):
        e.rules()


def test_nodes(shop):
    rows = {r["id"]: r for r in nodes.summaries(shop["nodes"]).collect()}
    assert rows["1"]["productions"] == ["shop.rules/bill"] and rows["1"]["queries"] == ["shop.rules/all-bills"] and rows["1"]["parents"] == [] and rows["4"]["parents"] == ["2"] and rows["3"]["queries"] == []


def test_folders_layers_and_command_line(shop, spark, tmp_path, capsys):
    for k in ("productions", "ancestors", "nodes"):
        shop[k].write.parquet(f"{tmp_path}/s/{k}.parquet")
    for k in S.MEMORY:
        shop[k].write.parquet(f"{tmp_path}/s.facts/{k}.parquet")
    (tmp_path / "a.json").write_text(json.dumps({"id": "curated", "merge-props": {"notes": "append"}, "annotations": {"shop.rules/pay": {"clara-rules/insert-types": [PAID], "notes": "seen"}}}))
    (tmp_path / "b.json").write_text("{}")
    loaded = S.load_session(spark, f"{tmp_path}/s")
    assert loaded.working_memory and loaded["facts"].count() == 5
    assert S.load_session(spark, "any", loader=lambda spark, a, b: {"productions": shop["productions"]})["facts"].count() == 0
    e = S.read_layers(spark, [f"{tmp_path}/a.json"])
    assert {r.key for r in e.collect()} == {"clara-rules/insert-types", "notes"}
    S.write_layer(e, f"{tmp_path}/out")
    assert sorted(map(str, S.read_layer_rows(spark, f"{tmp_path}/out").collect())) == sorted(map(str, e.collect()))
    for bad, error in (("c.json", FileNotFoundError), ("b.json", ValueError)):
        with pytest.raises(error):
            S.read_layers(spark, [f"{tmp_path}/{bad}"])
    assert cli.main(["-s", f"{tmp_path}/s", "-l", f"{tmp_path}/a.json", "--get", "/v1/rulebase-summary"]) == 0
    assert json.loads(capsys.readouterr().out)["rule-count"] == 4
    assert cli.main(["-s", f"{tmp_path}/s", "--get", "/v1/none"]) == 1 and cli.main([]) == 1 and cli.main(["-s", f"{tmp_path}/none"]) == 1
    assert cli.main(["-s", f"{tmp_path}/s", "-l", f"{tmp_path}/a.json", "--generate-analysis", f"{tmp_path}/gen"]) == 0
    assert spark.read.json(f"{tmp_path}/gen/analysis/productions").count() == 5
    for wrong in (["-p", "70000"], ["--working-memory-enabled", "maybe"]):
        with pytest.raises(SystemExit):
            cli.options().parse_args(wrong)


def test_server(shop):
    import threading
    import urllib.error
    import urllib.request

    server = cli.serve(E.Engine(shop.rulebase()), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"
    assert len(json.load(urllib.request.urlopen(f"{at}/v1/queries"))) == 1
    for route, status in (("/v1/x", 404), ("/v1/session/fact-types", 409)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(at + route)
        assert e.value.code == status
    server.shutdown()


def test_lists(engine, spark):
    rows = engine.analysis.summaries
    shown = lambda **k: {r["name"].split("/")[1] for r in catalog.view(rows, ["name", "doc"], F.col("ns"), **k).collect()}
    assert shown(query="BILL") == {"bill", "all-bills"} and shown(hidden=("shop.rules",)) == set() and shown(query="bill", hidden=("shop.rules",)) == {"bill", "all-bills"}
    assert shown(active=("unlinked",)) == {"idle", "pay"} and shown(query="pay", active=("sink",)) == set()
    every = ["a", "b", "c"]
    h = catalog.toggled(frozenset(), "a", every)
    assert h == {"b", "c"} and catalog.toggled(h, "b", every) == {"c"} and catalog.toggled(h, "a", every) == frozenset()
    got = catalog.related(rows, "downstream", ident(spark, BILL)).collect()
    assert [r["name"] for r in got] == ["shop.rules/bill"] and len(got[0]["refs"]) == 3
    assert catalog.categories({"matches": 2, "inserted": 0}) == [("matches", 2)]
    out = spark.createDataFrame([("a", "x"), (None, "x")], "item string, g string").select(catalog.filtered_out(F.col("item"), "b", ["item"], F.col("g"), (), ()).alias("o")).collect()
    assert [r.o for r in out] == [True, False]


def test_scan_of_namespaces(spark):
    uses = spark.createDataFrame([("app", "lib.a"), ("lib.a", "lib.b"), ("app", "clojure.core"), ("clojure.core", "lib.c"), ("lib.b", "other.x")], "from string, to string")
    start = spark.createDataFrame([("app",)], "ns string")
    assert {r.ns for r in extract.scanned(start, uses).collect()} == {"app", "lib.a", "lib.b", "other.x"}
    assert {r.ns for r in extract.scanned(start, uses, ("lib.",), ("lib.b",)).collect()} == {"app", "lib.a"}


def test_names(spark):
    rows = [("my.ns/verify-docs?", "my.ns-verify-docs-"), ('[:loan/status "verified"]', "loan-status-verified-"), ("x_y", "x-y-pjpwmhlx"), ("", "x-"), ("a" * 80, "a" * 60 + "-"), ("clojure.lang.IObj", "clojure.lang.IObj-r3vahgt5"), ("java.lang.Iterable", "java.lang.Iterable-ip5jrdp2")]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)] + [(9, None)], "i int, n string").select("i", names.route_id(F.col("n")).alias("r")).orderBy("i").collect()
    for r, (_, start) in zip(got, rows, strict=False):
        assert r.r.startswith(start) and len(r.r.rsplit("-", 1)[1]) == 8
    assert got[-1].r is None
    parts = spark.createDataFrame([("a.b/c/d",), ("a.B",), ('"q/x"',), ("[a/b]",), ("symbol[a/b]",), ("z",)], "n string").select(names.display_parts(F.col("n")).alias("p")).collect()
    assert [tuple(r.p) for r in parts] == [("d", "a.b/c"), ("B", "a"), ('"q/x"', ""), ("[a/b]", ""), ("symbol[a/b]", ""), ("z", "")]
    kinds = spark.createDataFrame([("keyword", "a/b", None), ("string", 'a"b\n', None), ("symbol", "x", None), ("symbol", "x", "p.X"), ("class", "p.X", None), ("keyword", None, None)], "k string, t string, r string")
    assert [r.n for r in kinds.select(names.type_name(F.col("k"), F.col("t"), F.col("r")).alias("n")).collect()] == [":a/b", '"a\\"b\\n"', "symbol[x]", "p.X", "p.X", None]


def test_props_layer_is_the_lowest(shop):
    merged = A.merge(A.props_layer(shop["productions"]).unionByName(S.layer_of(shop.spark, {"shop.rules/bill": {"insert-types": [NOTE, BILL]}})))
    assert [r.type for r in merged.types.filter("rule = 'shop.rules/bill'").orderBy("pos").collect()] == [BILL, NOTE]
    assert merged.provenance.filter("rule = 'shop.rules/bill'").first().layers == ["props", "source"]
