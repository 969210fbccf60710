"""Texts read with scopes: what they define, bind and use, and inference from texts alone."""

from collections import defaultdict

from rulelake import engine as E
from rulelake.functions import scopes
from rulelake.operators import callgraph, resolution, sourcing
from rulelake.sources import session as S
from tests.test_walks import SOURCE, place

HEAD = "(ns app (:require [clara.rules :refer [insert! retract! defrule]] [lib :refer [make]]))"
RECORDS = "(ns app)\n(defrecord Paid [a])\n(defrecord Side [a])\n(defrecord Bill [a])"


def told(text, *kinds):
    return [(e[3], e[5], *e[6:]) for e in scopes.events(text) if e[0] in kinds]


def uses(text):
    """Names that are used, with the number of the binding they belong to."""
    return [(e[3], e[5]) for e in scopes.events(text) if e[0] in ("usage", "local-usage") and e[3] not in ("let", "fn", "for", "letfn", "try", "as->", "defn")]


def test_scopes():
    assert uses("(let [a 1 b a] (f a b) (let [a b] a) a)") == [("a", 1), ("f", None), ("a", 1), ("b", 2), ("b", 2), ("a", 3), ("a", 1)]
    assert uses("(let [{:keys [a] b :x :as m :or {a (d)}} v [c & r :as w] m] [a b c m r w])") == [("v", None), ("d", None), ("m", 3), ("a", 1), ("b", 2), ("c", 4), ("m", 3), ("r", 5), ("w", 6)]
    assert uses("(fn me ([x] (me x)) ([x y] x))") == [("me", 1), ("x", 2), ("x", 3)]
    assert uses("(for [i is :let [j i] :when (p j)] i)") == [("is", None), ("i", 1), ("p", None), ("j", 2), ("i", 1)]
    assert uses("(letfn [(g [n] (h n)) (h [n] g)] (g 1))") == [("h", 2), ("n", 3), ("g", 1), ("g", 1)]
    assert uses("(try x (catch E e (f e)) (finally e))") == [("x", None), ("catch", None), ("E", None), ("f", None), ("e", 1), ("finally", None), ("e", None)]
    assert uses("(as-> x y (f y) y)") == [("x", None), ("f", None), ("y", 1), ("y", 1)]
    assert uses("(f 'q `(q) #'v @w ^T t :k \"s ) q\" \\) 1.5 -2 #_(gone) #\"r\" nil #(g % %1)) ; c") == [("f", None), ("v", None), ("w", None), ("t", None), ("g", None)]
    assert uses("(defn f [x] (let [f x] f))") == [("x", 1), ("f", 2)]
    assert told("(let [a\n  1]\n  a)", "local", "local-usage") == [("a", 1, 1, 7, 1, 8), ("a", 1, 3, 3, 3, 4)]


def test_texts_that_are_odd():
    assert not any(list(scopes.events(t)) for t in (None, "", " ; c", "(((", "]", "'", "^", "#_", "\""))
    assert [e[3] for e in scopes.events(") (a (b")] == ["a", "b"] and [e[3] for e in scopes.events("(a ^) b")] == ["a", "b"]
    deep = "(f " * 30_000 + "x" + ")" * 30_000
    assert len(list(scopes.events(deep))) == 30_001


def test_names_find_their_namespaces(spark):
    texts = {
        "a.clj": "(ns my.app (:require [lib.one :as l :refer [make other] :rename {other o2}] [lib.two :refer :all] far.away) (:import [java.util Date]))\n(defn own [] (l/make) (make) (o2) (whole) (far.away/x) (unknown) (l/gone) (own) (insert-me))",
        "b.clj": "(ns lib.one) (defn make []) (defn other []) (defrecord My-Rec [a])",
        "c.clj": "(ns lib.two (:use lib.three)) (defn whole [] (->T 1) (three))",
        "d.clj": "(ns lib.three) (deftype T [a]) (defn three [])",
        "e.clj": None,
    }
    s = sourcing.read(spark.createDataFrame(list(texts.items()), "filename string, text string"))
    got = {(r["from"], r.name, r.to) for r in s.usages.collect() if r["from_var"] and r.to}
    assert got == {("my.app", "make", "lib.one"), ("my.app", "other", "lib.one"), ("my.app", "whole", "lib.two"), ("my.app", "x", "far.away"), ("my.app", "gone", "lib.one"), ("my.app", "own", "my.app"), ("lib.two", "->T", "lib.three"), ("lib.two", "three", "lib.three")}
    assert {(r["from"], r.to) for r in s.namespace_usages.collect()} == {("my.app", "lib.one"), ("my.app", "lib.two"), ("my.app", "far.away"), ("lib.two", "lib.three")}
    records = {(r.ns, r.name, r.type) for r in s.records.collect()}
    assert records == {("lib.one", "My-Rec", "lib.one.My_Rec"), ("my.app", "l/My-Rec", "lib.one.My_Rec"), ("my.app", "Date", "java.util.Date"), ("lib.three", "T", "lib.three.T"), ("lib.two", "T", "lib.three.T")}
    assert len({r.usage_id for r in s.usages.collect()}) == s.usages.count()
    empty = sourcing.read(spark.createDataFrame([], "filename string, text string"))
    assert not any(x.count() for x in empty.tables().values())


def test_inference_from_texts_alone(spark):
    """The calls, locals and types of the small rulebase that other tests write by hand."""
    sources = spark.createDataFrame([("app.clj", HEAD + "\n" + SOURCE), ("facts.clj", RECORDS)], "filename string, text string")
    s = sourcing.read(sources)
    calls = {(r.caller, r.callee) for r in callgraph.calls(s.usages.filter("`to` is not null")).collect()}
    want = {"direct": ["clara.rules/insert!", "app/->Paid"], "local": ["clara.rules/insert!", "lib/make"], "helper": ["clara.rules/insert!", "app/->Side"], "far": ["app/helper"], "gone": ["clara.rules/retract!", "app/->Paid"], "loose": ["clara.rules/insert!"], "guess": ["app/loose", "app/->Bill"]}
    assert calls == {("app/" + k, x) for k, v in want.items() for x in v}
    row, col, _, end = place("(insert! f)", 2)
    assert [(r.row, r.col, r.end_col) for r in s.usages.filter("from_var = 'local' and name = 'insert!'").collect()] == [(row + 1, col, end)]
    names = spark.createDataFrame([(f"app/{x}",) for x in ("direct", "local", "far", "quiet", "gone", "guess")], "rule string")
    specs = spark.createDataFrame([("lib/make", 0)], "pattern string, spec int")
    found = resolution.infer(names, s.usages, sources, s.locals, s.local_usages, s.records, specs, lambda c: [":gold"] if ":gold" in c["arg_form"] else None)
    rows = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.rule, r.pos)):
        rows[r.rule.split("/")[1], r.dim].append((r.fields["source-str"], r.fields["status"], r.types))
    assert rows["direct", "insert"] == [("(->Paid 1)", "full", ["app.Paid"]), ("other", "none", [])]
    assert rows["local", "insert"] == [("(make :gold)", "full", [":gold"])]
    assert rows["far", "insert"] == [("x", "none", []), ("(->Side 2)", "full", ["app.Side"])]
    assert rows["gone", "retract"] == [("(->Paid 2)", "full", ["app.Paid"])] and ("quiet", "insert") not in rows
    # the bill is built outside of what inserts, so nothing stands in for it
    assert rows["guess", "insert"] == [("x", "none", [])]


def test_engine_reads_texts_and_aliases(spark):
    """A session with texts only; a rule's fact is a function, which inserts what the rule makes."""
    text = HEAD + "\n(defrecord Paid [a])\n(defn pay [x] (insert! (->Paid x)))\n(defrule bill [?f <- Fn] => (run ?f))\n(defrule plain [A] => (insert! (->Paid 1)))"
    lhs = {"app/bill": '[{"type": ":fn", "fact-binding": "?f"}]', "app/plain": '[{"type": "A"}]', "app/read": '[{"type": "app.Paid"}]'}
    productions = spark.createDataFrame([(i, n, "app", "rule", None, {}, None, x, "") for i, (n, x) in enumerate(lhs.items())], S.SCHEMAS["productions"])
    session = S.Session(spark, {"productions": productions, "sources": spark.createDataFrame([("app.clj", text)], "filename string, text string")})
    functions = spark.createDataFrame([(":fn", "app/pay")], "type string, var string")
    for spec, makers in ((E.Spec((), "auto-detect"), {"app/plain"}), (E.Spec((), "auto-detect", functions=functions), {"app/plain", "app/bill"})):
        types = E.Engine(session, spec).analysis.merged.types.collect()
        assert {(r.rule, r.dim, r.type) for r in types if r.type == "app.Paid"} == {(m, "insert", "app.Paid") for m in makers}
