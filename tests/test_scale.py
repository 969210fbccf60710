"""Edges, lists, counts and ids that must not cost a row for each pair: against brute force, with small bounds."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rulelake import runtime
from rulelake.functions import names
from rulelake.operators import annotations, depgraph, graph


@pytest.fixture(scope="module")
def rulebase(spark):
    r = random.Random(5)
    up = {(f"t{i}", f"k{i % 4}") for i in range(24)} | {(f"k{i}", "top") for i in range(4)} | {(f"t{i}", "top") for i in range(24)}
    usage = set()
    for p in range(30):
        kind = p % 6  # productions of a kind are alike, so that classes have several members
        s = random.Random(kind)
        usage |= {(f"p{p}", role, f"t{s.randrange(24)}") for role in ("insert", "retract") for _ in range(s.randrange(4))}
        usage |= {(f"p{p}", "consume", s.choice([f"k{s.randrange(4)}", f"t{s.randrange(24)}", "top"])) for _ in range(s.randrange(4))}
        if p % 7 == 0:
            usage.add((f"p{p}", "consume", f"t{r.randrange(24)}"))
    reflexive = up | {(t, t) for pair in up for t in pair}
    return usage, up, reflexive, spark.createDataFrame(sorted(usage), "prod string, role string, type string"), spark.createDataFrame(sorted(up), "type string, ancestor string"), spark.createDataFrame(sorted(reflexive), "type string, up string")


def _matches(usage, reflexive):
    return {(a, b, u) for a, r, t in usage if r != "consume" for x, u in reflexive if x == t for b, s, v in usage if s == "consume" and v == u and a != b}


def test_type_usage_counts_readers_of_ancestors_once(rulebase):
    usage, up, _, u, a, _ = rulebase
    rows = usage | {(p, r, d) for p, r, t in usage if r == "consume" for d, t2 in up if t2 == t} | {(p, r, x) for p, r, t in usage if r != "consume" for t2, x in up if t2 == t}
    n = lambda t, role: sum(1 for _, r, x in rows if x == t and r == role)
    out = depgraph.type_rollup(u, a)
    assert {tuple(r) for r in out.collect()} == {(t, n(t, "consume"), n(t, "insert"), n(t, "retract")) for t in {x for _, _, x in rows}}


def test_type_usage_has_no_row_for_each_reader_of_each_type(spark):
    usage = spark.range(1000).select(F.concat(F.lit("p"), "id").alias("prod"), F.lit("consume").alias("role"), F.lit("k").alias("type"))
    above = spark.range(1000).select(F.concat(F.lit("t"), "id").alias("type"), F.lit("k").alias("ancestor"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan is then the one that ran, with its counts
    try:
        out = depgraph.type_rollup(usage, above)
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(rows) == 1001 and {r.used_by for r in rows} == {1000}
    metrics, todo = [], [out._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.metrics().contains("numOutputRows"):
            metrics.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert metrics and max(metrics) < 10_000


def test_edges_are_distinct_without_a_shuffle_of_pairs(rulebase, monkeypatch):
    usage, _, reflexive, u, _, up = rulebase
    monkeypatch.setattr(depgraph, "MEMBERS", 2)
    expected = {(a, b) for a, b, _ in _matches(usage, reflexive)}
    out = depgraph.edges(u, up)
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    near = {r.prod: (r.upstream, r.downstream) for r in depgraph.neighbours(u, up).collect()}
    assert near == {p: (sorted(a for a, b in expected if b == p), sorted(b for a, b in expected if a == p)) for pair in expected for p in pair}


def test_lists_of_types_are_not_shuffled_for_each_type(rulebase, monkeypatch):
    """What is read goes to where classes are, in several parts as well, and each pair comes once."""
    usage, _, reflexive, u, _, up = rulebase
    monkeypatch.setattr(depgraph, "MEETING", 5, raising=False)
    out = depgraph.edges(u, up)
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a, b, _ in _matches(usage, reflexive)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(t" not in plan


def test_first_digits_are_those_of_the_whole_number(spark):
    def whole(n: int) -> str:
        out = ""
        while n:
            n, r = divmod(n, 36)
            out = names.BASE36[r] + out
        return out or "0"

    n = [36**k * a + b for k in range(31) for a in (1, 7) for b in (-1, 0, 1)] + [0, 2**160 - 1] + [int(hashlib.sha1(str(i).encode()).hexdigest(), 16) for i in range(2000)]
    rows = spark.createDataFrame([(f"{x:040x}",) for x in n if x >= 0], "h string")
    for length in (5, 8, 12):
        assert all(r.d == whole(int(r.h, 16))[:length] for r in rows.select("h", names.first_digits(F.col("h"), length).alias("d")).collect())


@pytest.mark.parametrize("side", ["upstream", "downstream"])
def test_productions_met_through_a_type_are_counted_without_pairs(rulebase, side):
    usage, _, reflexive, u, _, up = rulebase
    matches = {(a, b, t, v) for a, r, t in usage if r != "consume" for x, v in reflexive if x == t for b, s, w in usage if s == "consume" and w == v and a != b}
    assert {r.type for r in depgraph.meeting_types(u, up).collect()} == {v for *_, v in matches}
    for chosen in ("k1", "top", "t3", "t7"):
        ident = u.select(names.route_id(F.lit(chosen)).alias("i")).first()["i"]
        pairs = {(b, a) if side == "upstream" else (a, b) for a, b, t, v in matches if (v if side == "upstream" else t) == chosen}
        found = {r.name: r.n for r in depgraph.met(u, up, side, ident).collect()}
        assert found == {p: sum(1 for q, _ in pairs if q == p) for p, _ in pairs}


@pytest.mark.parametrize("most", [0, 6, 1000])
def test_walks_by_component_and_through_leaves(spark, most):
    """Components below and above the bound, and leaves with one parent: the same as walking one by one."""
    r = random.Random(3)
    small = [(f"s{k}.{a}", f"s{k}.{b}") for k in range(12) for a, b in [(0, 1), (1, 2), (2, 0), (1, 3)][: 1 + k % 4]]
    large = [(f"L{r.randrange(12)}", f"L{r.randrange(12)}") for _ in range(20)] + [("x", "x")]
    tree = [("root", f"m{i}") for i in range(3)] + [(f"m{i % 3}", f"leaf{i}") for i in range(80)] + [("m0", "root")]
    for pairs in (small + large, small + large + tree):
        after = {}
        for a, b in pairs:
            after.setdefault(a, set()).add(b)
        starts = sorted({a for a, _ in pairs}) + ["nowhere"]
        expected = set()
        for s in starts:
            seen, todo = set(), list(after.get(s, ()))
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += after.get(x, ())
            expected |= {(s, x) for x in seen}
        e, st = spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame([(s,) for s in starts], "start string")
        found = [tuple(r) for r in graph.reach(e, st, most).collect()]
        assert len(found) == len(set(found)) and set(found) == expected
    paths = lambda m: {(r.start, r.node): tuple(r.path) for r in graph.shortest(e, st, m).collect()}
    if most:
        assert paths(most) == paths(10_000)


def test_a_large_graph_does_not_come_to_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    e = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(9)], "a string, b string")

    def refuse(self):
        raise AssertionError("edges are collected")

    monkeypatch.setattr(DataFrame, "collect", refuse)
    assert graph._small(e, 8) is None


@pytest.fixture
def merging(spark):
    """Joins are broadcast only where the code says so."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_layers_without_resets_shuffle_no_value_and_write_types_once(spark, merging, monkeypatch):
    written = {}

    def cut(df, name="cut", own=annotations.cut):
        written[name] = own(df, name)
        return written[name]

    monkeypatch.setattr(annotations, "cut", cut)
    rows = [(1, "low", "a/r", "insert-types", '["X", "Y"]', {}), (2, "high", "a/r", "insert-types", '["Z", "x", "X"]', {}), (2, "high", "b/r", "retract-types", '["X"]', {})]
    entries = spark.createDataFrame(rows, annotations.ENTRIES)
    names = spark.createDataFrame([("a", "x", "Y"), ("a", "Z", None)], "ns string, symbol string, resolved string")
    m = annotations.merge(entries, bindings=names)
    assert [tuple(r) for r in m.types.orderBy("rule", "pos").collect()] == [("a/r", "insert", 0, "X"), ("a/r", "insert", 1, "Y"), ("b/r", "retract", 0, "X")]
    assert [r.type for r in m.listed.filter("rule = 'a/r'").orderBy("pos").collect()] == ["X", "Y", "Z"]
    assert "types" in written and "derived" not in written
    stored = {(r.rule, r.canon): r.type for r in written["types"].collect()}
    assert set(stored.values()) == {None}  # names equal to their canonical ones aren't written again
    plan = annotations.fold_types(annotations.normalised(entries).localCheckpoint())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_an_aggregate_is_not_made_to_be_counted(spark):
    never = spark.range(3).select(F.raise_error(F.lit("made")).alias("x"), "id").groupBy("id").agg(F.max("x").alias("x"))
    of = lambda most: runtime.sized(never, most, spark.range(3))._jdf.queryExecution().logical().toString()
    assert "Hint broadcast" in of(3) and "Hint merge" in of(2)


def test_types_are_lifted_without_being_made_distinct_first(rulebase, merging, monkeypatch):
    """Of what is made and read, only (production, type) by type and sets by production are shuffled."""
    plans, (_, _, _, u, _, up) = {}, rulebase

    def cut(df, name="cut", own=depgraph.cut):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return own(df, name)

    monkeypatch.setattr(depgraph, "cut", cut)
    depgraph._classes(u, up)
    assert "hashpartitioning(prod" in plans["sets"] and ", type" not in "".join(x.split(")")[0] for x in plans["sets"].split("hashpartitioning(")[1:])


@pytest.mark.parametrize("held", [0, 10**6])
def test_neighbours_neither_write_nor_shuffle_pairs(rulebase, spark, monkeypatch, held):
    """Lists come to where classes are, in several batches as well; by joins only beyond the bound. Names that tie in other orders,
    a production that meets only itself, and no production at all."""
    usage, _, reflexive, _, _, up = rulebase
    usage = usage | {("alone", "insert", "own"), ("alone", "consume", "own"), ("zé", "insert", "pair"), ("Z", "consume", "pair"), ("z", "consume", "pair"), ("\U0001f600", "consume", "pair"), ("￮", "consume", "pair")}
    reflexive = reflexive | {("own", "own"), ("pair", "pair")}
    up = up.unionByName(spark.createDataFrame([("own", "own"), ("pair", "pair")], "type string, up string"))
    monkeypatch.setattr(depgraph, "HELD", held)
    monkeypatch.setattr(depgraph, "NAMES", 3)
    written = []
    monkeypatch.setattr(depgraph, "cut", lambda df, name="cut", own=depgraph.cut: (written.append(name), own(df, name))[1])
    found = depgraph.neighbours(spark.createDataFrame(sorted(usage), "prod string, role string, type string"), up)
    expected = {(a, b) for a, b, _ in _matches(usage, reflexive)}
    bytewise = lambda names: sorted(names, key=str.encode)
    rows = {r.prod: (r.upstream, r.downstream) for r in found.collect()}
    assert rows == {p: (bytewise(a for a, b in expected if b == p), bytewise(b for a, b in expected if a == p)) for pair in expected for p in pair}
    assert ("pairs" in written) == (not held)
    assert depgraph.neighbours(spark.createDataFrame([], "prod string, role string, type string"), up).count() == 0
