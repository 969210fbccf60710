"""Layers folded one after the other: what each entry of a layer meets beneath it.

One ordered aggregate per rule and key, whose state is the value merged so far; the steps are those of the merge itself, so that
its result is the last state. Entries of a rule's key are as many as layers, which is what an array holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import annotations as A
from . import callsites, symbols

STEP = "array<struct<layer_pos:int,layer:string,entry:string,beneath:string>>"
_MAP = "map<string,string>"
_SITES = f"array<struct<id:string,fields:{_MAP},from_layer:string>>"


def _folded(rows: DataFrame, start: str, step, shown, *columns: str) -> DataFrame:
    """rule, key, layer_pos, layer, entry and beneath of each entry. step(state, entry) is the next state, null where nothing is
    left; shown(state or entry) its text."""
    order = F.array_sort(F.collect_list(F.struct("layer_pos", "layer", "value", "strategy", *columns)), lambda a, b: a["layer_pos"] - b["layer_pos"])
    zero = F.struct(F.lit(None).cast(start).alias("now"), F.array().cast(STEP).alias("out"))

    def one(a: Column, x: Column) -> Column:
        seen = F.struct(x["layer_pos"].alias("layer_pos"), x["layer"].alias("layer"), F.when(x["value"].isNotNull(), shown(x, True)).alias("entry"), F.when(a["now"].isNotNull(), shown(a["now"], False)).alias("beneath"))
        return F.struct(F.when(x["value"].isNotNull(), step(a["now"], x)).cast(start).alias("now"), F.concat(a["out"], F.array(seen)).alias("out"))

    return rows.groupBy("rule", "key").agg(order.alias("es")).select("rule", "key", F.inline(F.aggregate("es", zero, one)["out"]))


def types(entries: DataFrame, bindings: DataFrame | symbols.Table | None = None) -> DataFrame:
    """Unions of types, or the upper list alone where it replaces; of types with one canonical name the first stays."""
    rows = entries.filter(F.col("key").isin(*A.TYPES.values()))
    each = rows.select("rule", "key", "layer_pos", "layer", F.posexplode(F.from_json("value", "array<string>")).alias("i", "type")).filter("type is not null")
    each = A.canonical(each, bindings).groupBy("rule", "key", "layer_pos", "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "type", "canon"))), lambda x: F.struct(x["type"].alias("type"), x["canon"].alias("canon"))).alias("list"))
    rows = rows.join(each, ["rule", "key", "layer_pos", "layer"], "left")
    kind = "array<struct<type:string,canon:string>>"
    none = F.array().cast(kind)

    def step(now: Column, x: Column) -> Column:
        base = F.when((x["strategy"] == "replace") | now.isNull(), none).otherwise(now)
        return F.aggregate(F.coalesce(x["list"], none), base, lambda a, t: F.when(F.exists(a, lambda y: y["canon"] == t["canon"]), a).otherwise(F.concat(a, F.array(t))))

    return _folded(rows, kind, step, lambda v, entry: F.to_json(F.transform(F.coalesce(v["list"], none) if entry else v, lambda t: t["type"])), "list")


def scalars(entries: DataFrame) -> DataFrame:
    """All other keys but detections: the last value, or notes joined where they are appended."""
    rows = entries.filter(~F.col("key").isin(*A.TYPES.values(), *A.DETECTIONS.values())).withColumn("append", (F.col("key") == "notes") & F.coalesce(F.col("strategy") == "append", F.lit(False)))
    return _folded(rows, "string", lambda now, x: F.when(x["append"] & now.isNotNull(), F.concat_ws("\n", now, x["value"])).otherwise(x["value"]), lambda v, entry: v["value"] if entry else v, "append")


def _over(a: Column, b: Column) -> Column:
    """Map b over map a."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def _pairs(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def _one(key: str, value: Column) -> Column:
    """A map of one entry, empty where the value is null."""
    return F.when(value.isNotNull(), F.create_map(F.lit(key), value)).otherwise(F.create_map().cast(_MAP))


def detections(entries: DataFrame) -> DataFrame:
    """Callsites merged by id and field, stamped with their layers, and the resolution over all of them; a detection without
    callsites lays its fields over what is there."""
    rows = entries.filter(F.col("key").isin(*A.DETECTIONS.values())).withColumn("given", F.coalesce(F.from_json("value", _MAP), F.create_map().cast(_MAP)))
    has = F.map_contains_key("given", F.lit("callsites"))
    rows = rows.withColumns({"has": has, "own": F.map_filter("given", lambda k, v: k != "callsites"), "listed": F.from_json(F.try_element_at("given", F.lit("callsites")), f"array<{_MAP}>")})
    each = callsites.derive_ids(rows.select("rule", "key", "layer_pos", F.posexplode("listed").alias("idx", "fields")), ["rule", "key", "layer_pos"], "idx")
    each = each.groupBy("rule", "key", "layer_pos").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("callsite_id").alias("id"), "fields")), lambda a, b: a["idx"] - b["idx"]).alias("sites"))
    rows = rows.join(each, ["rule", "key", "layer_pos"], "left").withColumn("sites", F.coalesce("sites", F.array().cast(f"array<struct<idx:int,id:string,fields:{_MAP}>>")))
    kind = f"struct<own:{_MAP},has:boolean,sites:{_SITES}>"
    bare = lambda m: F.map_filter(m, lambda k, v: ~k.isin(*A.DERIVED))
    stamped = lambda x, s: F.struct(s["id"].alias("id"), bare(s["fields"]).alias("fields"), x["layer"].alias("from_layer"))
    plain = lambda m: F.map_filter(m, lambda k, v: k != "resolution")

    def step(now: Column, x: Column) -> Column:
        fresh = F.when(F.size(x["sites"]) > 0, F.struct(plain(x["own"]).alias("own"), F.lit(True).alias("has"), F.transform(x["sites"], lambda s: stamped(x, s)).alias("sites")))
        none = F.array().cast(_SITES)
        opaque = F.struct(F.when(now.isNull(), x["own"]).otherwise(_over(now["own"], x["own"])).alias("own"), F.coalesce(now["has"], F.lit(False)).alias("has"), F.coalesce(now["sites"], none).alias("sites"))

        def laid(s: Column) -> Column:
            above = F.filter(x["sites"], lambda b: b["id"] == s["id"])
            top = F.get(above, F.size(above) - 1)
            fields = bare(top["fields"])
            concludes = F.exists(F.map_keys(fields), lambda k: k.isin(*A.CONCLUSIONS))
            return F.when(F.size(above) > 0, F.struct(s["id"].alias("id"), _over(s["fields"], fields).alias("fields"), F.when(concludes, x["layer"]).otherwise(s["from_layer"]).alias("from_layer"))).otherwise(s)

        new = F.filter(x["sites"], lambda b: ~F.coalesce(F.exists(now["sites"], lambda s: s["id"] == b["id"]), F.lit(False)))
        both = F.concat(F.transform(now["sites"], laid), F.transform(new, lambda s: stamped(x, s)))
        deep = F.when(F.size(both) > 0, F.struct(_over(plain(now["own"]), plain(x["own"])).alias("own"), F.lit(True).alias("has"), both.alias("sites")))
        return F.when(~x["has"], opaque).when(now.isNull() | (x["strategy"] == "replace"), fresh).otherwise(deep)

    def shown(v: Column, entry: bool) -> Column:
        if entry:
            own, sites = v["own"], F.transform(v["sites"], lambda s: _pairs(_over(s["fields"], _one("callsite-id", s["id"]))))
        else:
            status = F.transform(v["sites"], lambda s: F.coalesce(F.try_element_at(s["fields"], F.lit("status")), F.lit("")))
            resolution = F.when(F.size(status) == 0, None).when(F.forall(status, lambda x: x == "full"), "full").when(F.forall(status, lambda x: x == "none"), "none").otherwise("partial")
            own = _over(v["own"], _one("resolution", F.when(v["has"], resolution)))
            sites = F.transform(v["sites"], lambda s: _pairs(_over(_over(s["fields"], _one("callsite-id", s["id"])), _one("from-layer", s["from_layer"]))))
        return F.to_json(F.struct(_pairs(own).alias("own"), v["has"].alias("has"), sites.alias("sites")))

    return _folded(rows, kind, step, shown, "has", "own", "sites")


def beneath(entries: DataFrame, bindings: DataFrame | symbols.Table | None = None) -> DataFrame:
    """rule, key, layer_pos, layer, entry and beneath: for each entry of each layer its value, null where it erases, and the
    merged value of all layers beneath it, null where there is none. Texts that are equal stand for values that are equal.

    bindings tells what types stand for. An empty table gives an empty one."""
    e = A.normalised(entries)
    return types(e, bindings).unionByName(scalars(e)).unionByName(detections(e))
