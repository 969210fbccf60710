"""Walks over graphs, and callsite resolution."""

import json
from collections import defaultdict

import pytest

from rulelake.functions import forms
from rulelake.operators import callgraph, graph, hierarchy, resolution
from rulelake.operators import annotations as A


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "caller string, callee string")


def name(i):
    return f"n{i:04d}"


@pytest.mark.parametrize("most", [0, graph.MOST_EDGES])
def test_long_chains_cycles_and_diamonds(spark, most):
    n = 200 if most else 24
    chain = [(name(i), name(i + 1)) for i in range(n)]
    assert callgraph.reachable(edges(spark, chain), most_edges=graph.MOST_EDGES).count() == n * (n + 1) // 2
    assert hierarchy.closure(edges(spark, chain), "caller", "callee", most).count() == n * (n + 1) // 2
    mixed = [("a", "b"), ("a", "c"), ("c", "d"), ("b", "d"), ("d", "a"), ("d", "e"), (None, "x"), ("a", "b")]
    got = {tuple(r) for r in hierarchy.closure(edges(spark, mixed), "caller", "callee", most).collect()}
    assert got == {(x, y) for x in "abcd" for y in "abcde"}
    paths = {r.node: r.path for r in callgraph.shortest_paths(edges(spark, mixed), spark.createDataFrame([("a",)], "start string"), most).collect()}
    assert paths == {"a": ["a"], "b": ["a", "b"], "c": ["a", "c"], "d": ["a", "b", "d"], "e": ["a", "b", "d", "e"]}
    assert callgraph.reachable(edges(spark, mixed).limit(0), most_edges=most).count() == 0


def test_the_boundary_is_reached_but_not_walked_on_from(spark):
    c = edges(spark, [("r", "h"), ("h", "clara.rules/insert!"), ("clara.rules/insert!", "inner"), ("r", "k"), ("k", "clara.rules/retract!")])
    got = callgraph.var_reachability(c, spark.createDataFrame([("h",), ("r",)], "s string")).orderBy("start").collect()
    assert got[0].reachable == ["clara.rules/insert!", "h"] and got[0].inserts and not got[0].retracts and got[1].retracts and "inner" not in got[1].reachable
    assert [r["var"] for r in callgraph.inserters(c).collect()] == ["h"]


def test_forms():
    assert forms.children("(f a, [b (c)] \"x ) y\" #_skip ; no\n {:k v} 'q #{1})") == ["f", "a", "[b (c)]", '"x ) y"', "{:k v}", "'q", "#{1}"]
    built = {"(->X 1)": "X", "(l/map->X {})": "l/X", "(new X 1)": "X", "(X. 1)": "X", "(a.X/new)": "a.X", "(f 1)": None, "[->X]": None, "": None, None: None}
    assert {k: forms.built_class(k) for k in built} == built
    lines = ["(let [f ; c", "  (->X 1)] (g", " f))"]
    assert forms.init_start(lines, 1, 8) == (2, 3) and forms.init_form(lines, 1, 8) == "(->X 1)" and forms.span(lines, 2, 12, 3, 4) == "(g\n f)" and forms.span(lines, 5, 1, 5, 2) is None
    assert forms.children("(a (b") == ["a", "(b"] and forms.children("\\a") == []


SOURCE = """(defrule direct [A] => (insert! (->Paid 1) other))
(defrule local [A] => (let [f (make :gold)] (insert! f)))
(defn helper [x] (insert! x (->Side 2)))
(defrule far [A] => (helper 1))
(defrule quiet [A] => nil)
(defrule gone [A] => (retract! (->Paid 2)))
(defn loose [x] (insert! x))
(defrule guess [A] => (loose (->Bill 3)))"""


def place(text, row):
    line = SOURCE.split("\n")[row - 1]
    col = line.index(text) + 1
    return row, col, row, col + len(text)


@pytest.fixture(scope="module")
def inferred(spark):
    call = [("direct", "clara.rules", "insert!", "(insert! (->Paid 1) other)", 1), ("direct", "app", "->Paid", "(->Paid 1)", 1), ("local", "clara.rules", "insert!", "(insert! f)", 2), ("local", "lib", "make", "(make :gold)", 2), ("helper", "clara.rules", "insert!", "(insert! x (->Side 2))", 3), ("helper", "app", "->Side", "(->Side 2)", 3), ("far", "app", "helper", "(helper 1)", 4), ("gone", "clara.rules", "retract!", "(retract! (->Paid 2))", 6), ("gone", "app", "->Paid", "(->Paid 2)", 6), ("loose", "clara.rules", "insert!", "(insert! x)", 7), ("guess", "app", "loose", "(loose (->Bill 3))", 8), ("guess", "app", "->Bill", "(->Bill 3)", 8), ("loose", "app", "->Bill", "(insert! x)", 7)]
    usages = spark.createDataFrame([(i, "app", v, to, n, "app.clj", *place(t, row)) for i, (v, to, n, t, row) in enumerate(call)], "usage_id long, `from` string, from_var string, `to` string, name string, filename string, row int, col int, end_row int, end_col int")
    sources = spark.createDataFrame([("app.clj", SOURCE)], "filename string, text string")
    bound, used = place("f (make", 2), place("(insert! f", 2)
    locals_ = spark.createDataFrame([("app.clj", 1, "f", 2, bound[1] + 1)], "filename string, id long, name string, row int, end_col int")
    uses = spark.createDataFrame([("app.clj", 1, "f", 2, used[1] + 9)], "filename string, id long, name string, row int, col int")
    records = spark.createDataFrame([("app", x, f"app.{x}") for x in ("Paid", "Side", "Bill")], "ns string, name string, type string")
    specs = spark.createDataFrame([("lib/make", 0)], "pattern string, spec int")
    rule_names = spark.createDataFrame([(f"app/{x}",) for x in ("direct", "local", "far", "quiet", "gone", "guess")], "rule string")

    def of_make(context):
        return [":gold"] if ":gold" in context["arg_form"] else None

    def asked(context):
        if context["arg_form"] == "other":
            raise RuntimeError("contained")
        return None

    sites = resolution.infer(rule_names, usages, sources, locals_, uses, records, specs, of_make, asked)
    return rule_names, sites.persist(), sites.collect()


def test_inferred_types(inferred):
    rows = defaultdict(list)
    for r in sorted(inferred[2], key=lambda r: (r.rule, r.pos)):
        rows[r.rule.split("/")[1], r.dim].append((r.fields["source-str"], r.fields["status"], r.types))
    assert rows["direct", "insert"] == [("(->Paid 1)", "full", ["app.Paid"]), ("other", "none", [])]
    assert rows["local", "insert"] == [("(make :gold)", "full", [":gold"])]
    assert rows["far", "insert"] == [("x", "none", []), ("(->Side 2)", "full", ["app.Side"])]
    assert rows["gone", "retract"] == [("(->Paid 2)", "full", ["app.Paid"])] and ("quiet", "insert") not in rows
    # nothing of loose's arguments is known: what is built beneath it stands in
    assert rows["guess", "insert"] == [("x", "none", []), ("->Bill", "full", ["app.Bill"])]


def test_routes_of_callsites(inferred):
    far = next(r for r in inferred[2] if r.rule == "app/far" and r.types)
    via = json.loads(far.fields["via"])
    assert via["boundary-in-var"] == "app/helper" and [s["var-name-sym"] for s in via["rule-to-boundary-path"]] == ["app/far", "app/helper"]
    made = next(r for r in inferred[2] if r.rule == "app/local")
    assert made.fields["constructor-sym"] == "lib/make" and [s["var-name-sym"] for s in json.loads(made.fields["via"])["boundary-to-constructor-path"]] == ["app/local", "lib/make"]
    assert len({(r.rule, r.dim, r.callsite_id) for r in inferred[2]}) == len(inferred[2])


def test_inferred_layer(spark, inferred):
    rule_names, sites, _ = inferred
    m = A.merge(resolution.entries(sites, rule_names))
    assert {(r.rule, r.type) for r in m.types.filter("dim = 'insert'").collect()} == {("app/direct", "app.Paid"), ("app/local", ":gold"), ("app/far", "app.Side"), ("app/guess", "app.Bill")}
    assert [r.rule for r in m.scalars.filter("key = 'no-output-types'").collect()] == ["app/quiet"]
    assert {(r.rule, r.resolution) for r in m.detections.filter("rule = 'app/direct'").collect()} == {("app/direct", "partial")}


def test_fallback_takes_types_that_are_read(spark):
    t = spark.createDataFrame([("a.X", 1), ("a.Y", 2), ("a.Z", 3)], "type string, n int")
    read = spark.createDataFrame([("a.X",), ("base",)], "type string")
    up = spark.createDataFrame([("a.Y", "base")], "type string, ancestor string")
    assert {r.type for r in resolution.admitted(t, read, up).collect()} == {"a.X", "a.Y"}


def test_aliases(spark):
    bindings = spark.createDataFrame([("app/r", "?f", ":fn"), ("app/r", "?g", ":fn"), ("app/q", "?f", ":bare")], "rule string, binding string, type string")
    used = spark.createDataFrame([("app/r", "?f"), ("app/q", "?f")], "rule string, name string")
    specs = spark.createDataFrame([(":fn", "lib/run"), (":bare", "run")], "type string, var string")
    pairs = callgraph.alias_pairs(bindings, used, specs)
    assert [tuple(r) for r in pairs.collect()] == [("app/r", ":fn", "lib/run")]
    u = callgraph.alias_usages(pairs).first()
    assert (u["from"], u.from_var, u.to, u.name, u.row) == ("app", "r", "lib", "run", None)
    near = spark.createDataFrame([("lib/run", "lib/run"), ("lib/run", "lib/deep")], "inserter string, node string")
    assert {(r.rule, r.caller, r.type) for r in callgraph.alias_contexts(pairs, near).collect()} == {("app/r", "lib/run", ":fn"), ("app/r", "lib/deep", ":fn")}
