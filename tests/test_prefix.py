"""Layers folded one after the other against a fold in plain Python, on random layers."""

import json
import random

from rulelake.operators import annotations as A
from rulelake.operators import prefix, reports
from rulelake.sources.session import layer_of

DETECTED = A.DETECTIONS["insert"]
DERIVED = ("from-layer", "dangling?")


def entry(r):
    """A random value of a random key, with a strategy."""
    key = r.choice(["insert-types", "retract-types", "notes", "owner", DETECTED])
    if r.random() < 0.12:
        return key, None, None
    if key.endswith("types"):
        return key, [r.choice("ABC") for _ in range(r.randint(0, 3))], r.choice([None, None, "replace"])
    if key == DETECTED:
        if r.random() < 0.3:
            return key, {"found": r.choice("xy")}, None
        sites = []
        for i in r.sample("123", r.randint(0, 2)):
            site = {"callsite-id": i} | {k: r.choice(v) for k, v in (("status", ["full", "none"]), ("source-str", ["s"]), ("from-layer", ["l0", "l1"])) if r.random() < 0.5}
            sites.append(site)
        v = {"callsites": sites} | ({"note": r.choice("ab")} if r.random() < 0.3 else {}) | ({"resolution": r.choice(["full", "none", "partial"])} if r.random() < 0.5 else {})
        return key, v, r.choice([None, None, "replace"])
    return key, r.choice("pq"), r.choice([None, "append"]) if key == "notes" else None


def step(now, key, v, strategy, layer):
    if v is None:
        return None
    if key.endswith("types"):
        return list(dict.fromkeys([*(now or [] if strategy != "replace" else []), *v]))
    if key == "notes":
        return f"{now}\n{v}" if strategy == "append" and now is not None else v
    if key != DETECTED:
        return v
    bare = lambda s: {k: x for k, x in s.items() if k not in DERIVED}
    if "callsites" not in v:
        return (now or {}) | v
    rest = {k: x for k, x in v.items() if k not in ("callsites", "resolution")}
    if now is None or strategy == "replace":
        sites, own = [bare(s) | {"from-layer": layer} for s in v["callsites"]], rest
    else:
        above = {s["callsite-id"]: bare(s) for s in v["callsites"]}
        sites = []
        for s in now.get("callsites", []):
            b = above.get(s["callsite-id"], {})
            sites.append(s | b | ({"from-layer": layer} if set(b) & set(A.CONCLUSIONS) else {}))
        known = {s["callsite-id"] for s in now.get("callsites", [])}
        sites += [bare(s) | {"from-layer": layer} for s in v["callsites"] if s["callsite-id"] not in known]
        own = {k: x for k, x in now.items() if k not in ("callsites", "resolution")} | rest
    if not sites:
        return None
    status = {s.get("status") for s in sites}
    return own | {"callsites": sites, "resolution": status.pop() if len(status) == 1 and status <= {"full", "none"} else "partial"}


def test_random_layers(spark):
    r, every, want, last = random.Random(11), None, set(), {}
    for i in range(6):
        layer, props = {}, {}
        for rule in range(40):
            layer[f"ns/r{rule}"] = {}
            for _ in range(r.randint(0, 4)):
                key, v, strategy = entry(r)
                layer[f"ns/r{rule}"][key] = v
                props[f"ns/r{rule}", key] = strategy
        for rule, keys in layer.items():
            mine = {k: props[rule, k] for k in keys if props[rule, k]}
            for key, v in keys.items():
                now = last.get((rule, key))
                if v is not None and now is not None and v == now:
                    want.add((rule, key, f"l{i}"))
                last[rule, key] = step(now, key, v, props[rule, key], f"l{i}")
            if mine:
                keys["merge-props"] = mine
        e = layer_of(spark, {k: {a: (json.dumps({x: y if isinstance(y, str) else json.dumps(y) for x, y in b.items()}) if isinstance(b, dict) else b) for a, b in v.items()} for k, v in layer.items() if v}, f"l{i}", i)
        every = e if every is None else every.unionByName(e)
    rows = prefix.beneath(every).collect()
    assert {(x.rule, x.key, x.layer) for x in rows if x.entry is not None and x.entry == x.beneath} == want
    assert {k for _, k, _ in want} == {"insert-types", "retract-types", "notes", "owner", DETECTED}
    found = reports.no_ops(every).collect()
    assert len(found) == len(want) and {(x.rule, x.layer) for x in found} == {(a, c) for a, _, c in want}


def test_names_and_empty_tables(spark):
    names = spark.createDataFrame([("ns", "Foo", "a.Foo")], "ns string, symbol string, resolved string")
    two = layer_of(spark, {"ns/r": {"insert-types": ["Foo"]}}, "a", 0).unionByName(layer_of(spark, {"ns/r": {"insert-types": ["a.Foo"]}}, "b", 1)).unionByName(layer_of(spark, {"ns/r": {"insert-types": ["Foo"]}}, "c", 2))
    assert {x.layer: x.beneath for x in prefix.beneath(two, names).collect()} == {"a": None, "b": '["Foo"]', "c": '["Foo"]'}
    assert {x.layer: x.beneath for x in prefix.beneath(two).collect()} == {"a": None, "b": '["Foo"]', "c": '["Foo","a.Foo"]'}
    assert prefix.beneath(two.limit(0)).collect() == []
