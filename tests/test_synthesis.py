"""Texts of namespaces assembled from rows, and rows about them turned back to rules."""

from rulelake import engine as E
from rulelake.functions import scopes
from rulelake.operators import sourcing, synthesis
from rulelake.sources import session as S

NONE = "ns string, filename string, text string"


def rules(spark, *rows):
    return spark.createDataFrame([(i, name, name.split("/")[0], kind, None, {}, None, None, rhs) for i, (name, kind, rhs) in enumerate(rows)], S.SCHEMAS["productions"])


def made(spark, productions, base=(), mappings=(), defs=()):
    t = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return synthesis.combined(productions, t(base, NONE), t(mappings, S.SCHEMAS["mappings"]), t(defs, S.SCHEMAS["var_defs"]))


def test_single_forms():
    yes = ["a", "(a (b) [c] {d #{e}})", "'a", "#'a", "^:k a", " a ; c", '"x ) y"', "@a", "\\)", ":k", "12"]
    no = ["", None, "a b", "(a", "a)", "(a) (b)", "'", '"x', "; c", "^", "(a))(", ")("]
    assert [scopes.single(t) for t in yes] == [True] * len(yes) and [scopes.single(t) for t in no] == [False] * len(no)


def test_from_mappings(spark):
    """Sorted clauses, defaults left out, what a namespace defines declared, odd definitions told of."""
    p = rules(spark, ("x.y-z/one", "rule", "(insert! (->A 1))"), ("x.y-z/two", "rule", "(do\n 1)"), ("x.y-z/ask", "query", None), ("x.y-z/bare", "rule", None))
    mappings = [("x.y-z", *m) for m in (("refer", "b", "q.r/b"), ("refer", "a", "q.r/a"), ("refer", "a", "q.r/a"), ("alias", "q", "q.r"), ("alias", "e", "a.b"), ("import", "UUID", "java.util.UUID"), ("import", "Date", "java.util.Date"), ("import", "File", "java.io.File"), ("import", "Long", "java.lang.Long"), ("refer", "inc", "clojure.core/inc"), ("define", "one", None), ("define", "ask", None), ("define", "h2", None), ("define", "h1", None), ("unmap", "Process", None), ("exclude", "map", None), ("rename", "core-get", "get"), ("other", "x", "y"))]
    defs = [("x.y-z", 1, "h2", "(def h2 2)"), ("x.y-z", 0, "h1", "(defn h1 [] 1)"), ("x.y-z", 2, "two", "(def two 0)"), ("x.y-z", 3, "m", "(def m\n 1)"), ("x.y-z", 4, "u", "(def u"), ("x.y-z", 5, "n", None)]
    c = made(spark, p, (), mappings, defs)
    text = c.texts.first()
    assert text.filename == "x/y_z.clj" and text.offset == 5
    assert text.text.split("\n") == [
        "(ns x.y-z (:refer-clojure :exclude [map] :rename {get core-get}) (:require [a.b :as e] [q.r :as q] [q.r :refer [a b]]) (:import [java.io File] [java.util Date UUID]))",
        "(ns-unmap (the-ns 'x.y-z) 'Process)",
        "(declare h1 h2)",
        "(defn h1 [] 1)",
        "(def h2 2)",
        "",
        "(def __rule_0__ (fn [] (insert! (->A 1))))",
        "(def __rule_1__ (fn [] (do",
        " 1)))",
        "",
    ]
    assert sorted(tuple(r) for r in c.tags.collect()) == [("x.y-z", "__rule_0__", "one", 7, 7), ("x.y-z", "__rule_1__", "two", 8, 9)]
    assert {(r.name, r.reason) for r in c.skipped.collect()} == {("m", "multiline"), ("u", "unreadable")}
    empty = made(spark, p.limit(0))
    assert not empty.texts.count() and not empty.tags.count()
    assert made(spark, rules(spark, ("n/r", "rule", "(f)"))).texts.first().text == "(ns n)\n\n(def __rule_0__ (fn [] (f)))\n"


def test_round_trip_with_the_text_there_is(spark):
    """A rule's own definition goes, its right side stands for it; helpers and queries' neighbours stay."""
    real = "(ns app (:require [lib :refer [f g h]]))\n(defrule r [A] => (f 1))\n(defn help [] (g))\n(defquery q [] [B (h)])\n"
    p = rules(spark, ("app/r", "rule", "(do (g 1)\n (help))"), ("app/q", "query", None))
    sources = spark.createDataFrame([("app.clj", real), ("other.clj", "(ns other) (def x 1)")], "filename string, text string")
    base = sourcing.namespace_texts(sources)
    assert {r.ns for r in base.collect()} == {"app", "other"}
    c = made(spark, p, [tuple(r) for r in base.collect()])
    every = synthesis.all_texts(sources, c)
    assert {r.filename: r.text.startswith(real) for r in every.collect()} == {"app.clj": True, "other.clj": False} and c.texts.first().offset == 4
    usages = synthesis.pruned_usages(sourcing.read(every).usages, p, c).filter("`to` is not null and from_var is not null")
    assert {(r.from_var, r.name, r.row) for r in usages.collect()} == {("r", "g", 6), ("r", "help", 7), ("help", "g", 3)}


def test_engine_reads_rules_without_texts(spark):
    """A session of productions and mappings alone: what rules make is read from assembled texts."""
    p = rules(spark, ("app/make", "rule", "(insert! (->Paid 1))"), ("app/none", "rule", "(do nil)"))
    mappings = spark.createDataFrame([("app", "refer", "insert!", "clara.rules/insert!"), ("app", "import", "Paid", "app.Paid")], S.SCHEMAS["mappings"])
    a = E.Engine(S.Session(spark, {"productions": p, "mappings": mappings}), E.Spec((), "auto-detect")).analysis.merged
    assert [(r.rule, r.dim, r.type) for r in a.types.collect()] == [("app/make", "insert", "app.Paid")]
    assert {(r.rule, r.key) for r in a.scalars.collect()} == {("app/none", "no-output-types")}
