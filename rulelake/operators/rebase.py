"""Moving layers to renamed namespaces. mapping: {old namespace: new namespace}, given by the caller, a literal in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import annotations as A
from . import callsites

#: What a callsite's route is made of.
ROUTE_NAMES = ("boundary-var-name-sym", "boundary-in-var")
ROUTE_PATHS = ("boundary-to-constructor-path", "rule-to-boundary-path")


def _map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.create_map().cast("map<string,string>")


def qualified(name: Column, mapping: dict[str, str]) -> Column:
    """ns/name or a bare namespace, moved; a keyword keeps its colon. Names of other namespaces stay."""
    colon = F.when(name.startswith(":"), ":").otherwise("")
    bare = F.regexp_replace(name, "^:", "")
    at = F.instr(bare, "/")
    ns = F.when(at > 0, F.substring_index(bare, "/", 1)).otherwise(bare)
    new = F.element_at(_map(mapping), ns)
    return F.when(new.isNull(), name).otherwise(F.concat(colon, new, F.when(at > 0, bare.substr(at, F.length(bare))).otherwise("")))


def path(ns: str) -> str:
    return ns.replace("-", "_").replace(".", "/")


def filename(name: Column, mapping: dict[str, str]) -> Column:
    """A source path beneath a moved namespace's path: up to a slash or a dot."""
    for old, new in mapping.items():
        a, b = path(old), path(new)
        follows = name.startswith(a) & name.substr(F.lit(len(a) + 1), F.lit(1)).isin("/", ".")
        name = F.when(follows, F.concat(F.lit(b), name.substr(F.lit(len(a) + 1), F.length(name)))).otherwise(name)
    return name


def _steps(text: Column, mapping: dict[str, str]) -> Column:
    steps = F.from_json(text, "array<map<string,string>>")
    return F.to_json(F.transform(steps, lambda s: F.transform_values(s, lambda k, v: F.when(k == "var-name-sym", qualified(v, mapping)).otherwise(v))))


def route(text: Column, mapping: dict[str, str]) -> Column:
    """A callsite's route (JSON): its names, and each step of its paths."""
    fields = F.from_json(text, "map<string,string>")
    moved = F.transform_values(fields, lambda k, v: F.when(k.isin(*ROUTE_NAMES), qualified(v, mapping)).when(k.isin(*ROUTE_PATHS), _steps(v, mapping)).otherwise(v))
    # nested texts that are JSON stay JSON
    pair = lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.when(e["value"].rlike(r"^[\[{]"), e["value"]).otherwise(F.coalesce(F.to_json(F.array(e["value"])).substr(F.lit(2), F.length(F.to_json(F.array(e["value"]))) - 2), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(moved), pair), ","), F.lit("}"))


def callsite(fields: Column, mapping: dict[str, str]) -> Column:
    """All fields of a callsite moved. With a namespace and a source left, its id is dropped, to be derived again."""
    types = lambda v: F.to_json(F.transform(F.from_json(v, "array<string>"), lambda t: qualified(t, mapping)))
    moved = F.transform_values(
        fields,
        lambda k, v: F.when(k.isin("ns-name-sym", "constructor-sym", "fact-type"), qualified(v, mapping)).when(k == "filename", filename(v, mapping)).when(k == "resolved-types", types(v)).when(k == "via", route(v, mapping)).otherwise(v),
    )
    has = F.element_at(moved, "ns-name-sym").isNotNull() & F.element_at(moved, "source-str").isNotNull()
    return F.map_filter(moved, lambda k, v: ~(has & (k == "callsite-id")))


def entries(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """A layer's entries under the new names: rules and, in detections, all callsites, with new ids."""
    e = rows.withColumns({"rule": qualified(F.col("rule"), mapping), "__key": A.unqualified(F.col("key"))})
    has = F.col("__key").isin(*A.DETECTIONS.values()) & F.coalesce(F.map_contains_key(F.from_json("value", "map<string,string>"), "callsites"), F.lit(False))
    plain = e.filter(~F.coalesce(has, F.lit(False)))
    det = e.filter(has).withColumn("__all", F.from_json("value", "map<string,string>"))
    keep = ["layer_pos", "layer", "rule", "key", "props"]
    sites = det.select("layer_pos", "rule", "key", F.posexplode(F.from_json(F.element_at("__all", F.lit("callsites")), "array<map<string,string>>")).alias("idx", "fields")).withColumn("fields", callsite(F.col("fields"), mapping))
    sites = callsites.derive_ids(sites, ["layer_pos", "rule", "key"], "idx")
    named = F.when(F.col("callsite_id").isNull(), F.col("fields")).otherwise(F.map_concat(F.map_filter("fields", lambda k, v: k != "callsite-id"), F.create_map(F.lit("callsite-id"), F.col("callsite_id"))))
    listed = sites.withColumn("fields", named).groupBy("layer_pos", "rule", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.to_json("fields").alias("s")))), lambda x: x["s"]).alias("__sites"))
    rest = F.map_filter("__all", lambda k, v: k != "callsites")
    value = F.to_json(F.map_concat(rest, F.create_map(F.lit("callsites"), F.concat(F.lit("["), F.array_join(F.coalesce("__sites", F.array().cast("array<string>")), ","), F.lit("]")))))
    moved = det.join(listed, ["layer_pos", "rule", "key"], "left").withColumn("value", value)
    return plain.select(*keep, "value").unionByName(moved.select(*keep, "value")).select("layer_pos", "layer", "rule", "key", "value", "props")
