"""From productions to rows: conditions, the types they read, bindings, and lists of names.

productions(prod_ord, name, ns, kind, doc, props, params, lhs, rhs): lhs is a JSON array of conditions. A condition is an
object with type (a printed name), constraints, args and fact-binding; or with accumulator, from (a condition) and
result-binding; or with constraints alone (a test); or a group: an array of its operator (and, or, not, exists) and conditions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names

CONDITIONS = "prod string, prod_ord int, pos int, depth int, path array<int>, op string, type string, constraints string, args string, accumulator string, fact_binding string, result_binding string"
GROUPS = ("and", "or", "not", "exists")
#: Namespaces that a source scan leaves out unless it is told otherwise.
EXCLUDED = (
    "clojure.",
    "cljs.",
    "schema.",
    "ham-fisted.",
    "futurama.",
    "manifold.",
    "potemkin.",
    "riddley.",
    "clj-commons.",
    "clj-kondo.",
    "cider.",
    "nrepl.",
)


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _type(value) -> str | None:
    return value.get("name") if isinstance(value, dict) else value


def flatten(lhs: list) -> list[tuple]:
    """(pos, depth, path, op, type, constraints, args, accumulator, fact binding, result binding), depth first. What an
    accumulator reads from comes beneath it."""
    out: list[tuple] = []

    def walk(c, path: list[int]) -> None:
        if isinstance(c, list):
            op, inner = str(c[0]).lstrip(":") if c else "and", c[1:]
            out.append((len(out), len(path), path, op, None, None, None, None, None, None))
            for i, x in enumerate(inner):
                walk(x, [*path, i])
            return
        if "accumulator" in c:
            out.append((len(out), len(path), path, "accumulator", None, None, None, _text(c["accumulator"]), None, c.get("result-binding")))
            if c.get("from") is not None:
                walk(c["from"], [*path, 0])
            return
        op = "fact" if c.get("type") is not None else "test"
        out.append((len(out), len(path), path, op, _type(c.get("type")), _text(c.get("constraints")), _text(c.get("args")), None, c.get("fact-binding"), None))

    for i, c in enumerate(lhs or []):
        walk(c, [i])
    return out


def conditions(productions: DataFrame) -> DataFrame:
    """CONDITIONS of every production; one without a left side has none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("prod", pa.string()), ("prod_ord", pa.int32()), ("pos", pa.int32()), ("depth", pa.int32()), ("path", pa.list_(pa.int32())), *[(k, pa.string()) for k in ("op", "type", "constraints", "args", "accumulator", "fact_binding", "result_binding")]])
        for b in batches:
            found = [(name, at, *r) for name, at, lhs in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in flatten(json.loads(lhs) if lhs else [])]
            cols = list(zip(*found, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return productions.select("name", F.col("prod_ord").cast("int").alias("prod_ord"), "lhs").mapInArrow(rows, CONDITIONS)


def read_types(conds: DataFrame) -> DataFrame:
    """prod, prod_ord, pos, type: distinct types of a production's conditions, those beneath a not as well, by first place."""
    return conds.filter("type is not null").groupBy("prod", "prod_ord", "type").agg(F.min("pos").alias("pos"))


def rulebase_types(conds: DataFrame) -> DataFrame:
    return conds.filter("type is not null").select("type").distinct()


def bindings(conds: DataFrame) -> DataFrame:
    """prod, binding, type: bound facts, and an accumulator's result once for each type it reads."""
    facts = conds.filter("fact_binding is not null and type is not null").select("prod", F.col("fact_binding").alias("binding"), "type")
    acc = conds.filter("result_binding is not null").select("prod", F.col("path").alias("at"), "result_binding")
    under = acc.join(conds.filter("type is not null").select("prod", "path", "type"), "prod").filter(F.slice("path", F.lit(1), F.size("at")) == F.col("at"))
    return facts.unionByName(under.select("prod", F.col("result_binding").alias("binding"), "type").distinct())


def with_namespace(productions: DataFrame) -> DataFrame:
    """ns: the declared one, else that of the name (queries have no own)."""
    return productions.withColumn("ns", names.production_ns(F.col("ns"), F.col("name")))


def latest(productions: DataFrame) -> DataFrame:
    """One production per name: a later one with the same name wins, at the first one's place."""
    rest = [c for c in productions.columns if c not in ("name", "prod_ord")]
    return productions.groupBy("name").agg(F.min("prod_ord").alias("prod_ord"), F.max_by(F.struct(*rest), "prod_ord").alias("v")).select("prod_ord", "name", "v.*").select(*productions.columns)


def rules_by_namespace(productions: DataFrame) -> DataFrame:
    """ns and its rules in order of their names; rules without a namespace are left out."""
    rows = with_namespace(productions).filter("kind = 'rule' and ns is not null")
    return rows.groupBy("ns").agg(F.array_sort(F.collect_list("name")).alias("rules"))


def rule_names(productions: DataFrame, queries: bool = False) -> DataFrame:
    return productions.filter(F.lit(queries) | (F.col("kind") == "rule")).select("name").distinct()


def namespaces(productions: DataFrame) -> DataFrame:
    return with_namespace(productions).filter("ns is not null").select("ns").distinct()


def required(namespace_usages: DataFrame) -> DataFrame:
    return namespace_usages.filter("to is not null").select(F.col("to").alias("ns")).distinct()


def _under(ns, prefixes: tuple[str, ...]):
    out = F.lit(False)
    for p in prefixes:
        out |= ns.startswith(p)
    return out


def scanned(starting: DataFrame, namespace_usages: DataFrame, include: tuple[str, ...] | None = None, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """ns: all that the starting namespaces require, directly or not, with themselves. Of the others, only those beneath an
    included prefix, if any are given, and never those beneath an excluded one: they are not walked on from."""
    from . import graph

    to = F.col("to")
    admitted = ~_under(to, exclude) if include is None else (_under(to, include) & ~_under(to, exclude))
    edges = namespace_usages.filter(admitted).select("from", "to")
    near = graph.reach(edges, starting.select("ns")).select(F.col("node").alias("ns"))
    return starting.select("ns").unionByName(near).distinct()


def pruned(rows: DataFrame, offsets: DataFrame, tags: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows of a source analysis (ns, name, row, ..) once production texts were appended: those of known productions up to
    their namespace's offset go (the appended texts stand for them), and a tag's name becomes its production's.

    offsets(ns, offset); tags(ns, tag, production); known(ns, name): all productions, those of tags if not given. All are of the
    size of the rulebase. Rows without a namespace, name or row stay."""
    every = tags.select("ns", F.col("production").alias("name")) if known is None else known.select("ns", "name")
    every = every.distinct().withColumn("__known", F.lit(True))
    out = rows.join(every, ["ns", "name"], "left").join(offsets, "ns", "left")
    gone = F.col("__known").isNotNull() & (F.col("row") <= F.coalesce("offset", F.lit(0)))
    out = out.filter(~F.coalesce(gone, F.lit(False))).drop("__known", "offset").join(tags.withColumnRenamed("tag", "name"), ["ns", "name"], "left")
    return out.withColumn("name", F.coalesce("production", "name")).drop("production").select(*rows.columns)


def usage(conds: DataFrame, types: DataFrame) -> DataFrame:
    """prod, role (consume, insert, retract), pos, type of every production. types(rule, dim, pos, type): merged annotations."""
    return read_types(conds).select("prod", F.lit("consume").alias("role"), "pos", "type").unionByName(types.select(F.col("rule").alias("prod"), F.col("dim").alias("role"), F.col("pos").cast("int").alias("pos"), "type"))


def form_of(condition) -> str:
    """A condition as it would be written in a rule."""
    if isinstance(condition, list):
        return "[" + " ".join([":" + str(condition[0]).lstrip(":"), *map(form_of, condition[1:])]) + "]"
    parts = []
    listed = lambda v: v if isinstance(v, list) else [v]
    if "accumulator" in condition:
        if condition.get("result-binding"):
            parts += [str(condition["result-binding"]), "<-"]
        acc = condition["accumulator"]
        parts.append("(" + " ".join(map(str, acc)) + ")" if isinstance(acc, list) else str(acc))
        if condition.get("from") is not None:
            parts += [":from", form_of(condition["from"])]
        return "[" + " ".join(parts) + "]"
    if condition.get("type") is None:
        return "[" + " ".join([":test", *map(str, listed(condition.get("constraints") or []))]) + "]"
    if condition.get("fact-binding"):
        parts += [str(condition["fact-binding"]), "<-"]
    parts.append(_type(condition["type"]))
    if condition.get("args"):
        parts.append(condition["args"] if isinstance(condition["args"], str) else "[" + " ".join(map(str, condition["args"])) + "]")
    parts += [str(x) for x in listed(condition.get("constraints") or [])]
    return "[" + " ".join(parts) + "]"


def lhs_forms(productions: DataFrame) -> DataFrame:
    """name and lhs_form: the left side as it would be written, a condition a line."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = ["\n".join(map(form_of, json.loads(x) if x else [])) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.string())], names=["name", "lhs_form"])

    return productions.select("name", "lhs").mapInArrow(rows, "name string, lhs_form string")
