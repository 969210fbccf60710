"""Work lists and lints of annotation layers. Each lint returns FINDING rows; columns that don't apply are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import annotations as A
from . import callsites, prefix, symbols

FINDING = ("severity", "type", "layer", "rule", "dim", "callsite_id", "message")


def finding(rows: DataFrame, severity: str, kind: str, message: Column, **columns: str) -> DataFrame:
    given = {"layer": "layer", "rule": "rule", "dim": "dim", "callsite_id": "callsite_id"} | columns
    one = lambda c: (F.col(given[c]) if given[c] in rows.columns else F.lit(None)).cast("string").alias(c)
    return rows.select(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), *[one(c) for c in ("layer", "rule", "dim", "callsite_id")], message.alias("message"))


def group_prefix(callsite_id: Column) -> Column:
    """A callsite id without its last segment, the ordinal."""
    return F.when(F.instr(callsite_id, ":") > 0, F.regexp_replace(callsite_id, ":[^:]*$", "")).otherwise(F.when(callsite_id.isNotNull(), F.lit("")))


def work_list(merged: A.Merged) -> DataFrame:
    """rule, dim, resolution, callsite_id, status, source, ns, ctor of what is left to resolve: sites that aren't fully
    resolved and don't dangle."""
    rows = merged.sites.withColumn("status", callsites.field("status")).filter(~F.col("dangling") & ~F.col("status").eqNullSafe(F.lit("full")))
    named = rows.select("rule", "dim", "pos", "callsite_id", "status", callsites.field("source-str").alias("source"), callsites.field("ns-name-sym").alias("ns"), callsites.field("constructor-sym").alias("ctor"))
    return named.join(merged.detections.select("rule", "dim", "resolution"), ["rule", "dim"])


def dangling_list(merged: A.Merged) -> DataFrame:
    """rule, dim, callsite_id, from_layer and evidence of the quarantined sites."""
    return merged.sites.filter("dangling").select("rule", "dim", "callsite_id", "from_layer", callsites.field("resolution-evidence").alias("evidence"))


def work_summary(merged: A.Merged) -> DataFrame:
    """One row: rules, callsites and by_resolution of the work list, and how many sites dangle."""
    w = work_list(merged)
    per = w.groupBy("status").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("status", F.lit("")).alias("k"), F.col("n").alias("v"))))).alias("by_resolution"))
    counts = w.agg(F.countDistinct("rule").alias("rules"), F.count("*").alias("callsites"))
    return counts.crossJoin(per).crossJoin(merged.sites.agg(F.count_if("dangling").alias("dangling")))  # one row each


def unknown_rules(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Rules of a layer that no production is called by: a typing error would be merged as a rule of its own. known(rule)."""
    rows = entries.select("layer", "rule").distinct().join(known.select("rule").distinct(), "rule", "left_anti")
    return finding(rows, "error", "unknown-rule", F.concat(F.lit("no rule is called "), "rule"))


def declared_sites(entries: DataFrame) -> DataFrame:
    """layer, rule, dim, idx, fields and callsite_id of the callsites that layers declare, before any merge."""
    rows = entries.withColumn("key", A.unqualified(F.col("key"))).filter(F.col("key").isin(*A.DETECTIONS.values()) & F.col("value").isNotNull())
    fields = F.from_json("value", "map<string,string>")
    rows = rows.select("layer", "layer_pos", "rule", F.when(F.col("key") == A.DETECTIONS["insert"], "insert").otherwise("retract").alias("dim"), F.posexplode(F.from_json(F.element_at(fields, "callsites"), "array<map<string,string>>")).alias("idx", "fields"))
    return callsites.derive_ids(rows, ["rule", "dim", "layer_pos"], "idx")


def structure(entries: DataFrame) -> DataFrame:
    """Conclusions without types, and fields that only a merge may write."""
    sites = declared_sites(entries)
    types = F.coalesce(F.from_json(callsites.field("resolved-types"), "array<string>"), F.array().cast("array<string>"))
    bare = sites.filter(callsites.field("status").isin("full", "partial") & (F.size(types) == 0))
    out = finding(bare, "error", "resolved-without-types", F.concat(F.lit("status "), callsites.field("status"), F.lit(" without resolved types")))
    for k in A.DERIVED:
        out = out.unionByName(finding(sites.filter(callsites.declares(k)), "warn", "authored-derived-field", F.lit(f"{k} is computed by the merge; the value is ignored")))
    return out.unionByName(_resolutions(entries))


def _resolutions(entries: DataFrame) -> DataFrame:
    """A detection's resolution, written by a layer that discovered not all of its callsites."""
    rows = entries.withColumn("key", A.unqualified(F.col("key"))).filter(F.col("key").isin(*A.DETECTIONS.values()) & F.col("value").isNotNull()).withColumn("fields", F.from_json("value", "map<string,string>"))
    listed = F.coalesce(F.from_json(F.element_at(F.col("fields"), "callsites"), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    wrong = rows.filter(callsites.declares("resolution") & F.exists(listed, lambda s: ~F.map_contains_key(s, "filename"))).withColumn("dim", F.when(F.col("key") == A.DETECTIONS["insert"], "insert").otherwise("retract"))
    return finding(wrong, "warn", "authored-derived-field", F.lit("resolution is computed by the merge; the value is ignored"))


def ambiguous(entries: DataFrame, merged: A.Merged) -> DataFrame:
    """References into a group of equal callsites: their ordinals are places, which may shift."""
    found = merged.sites.filter(~F.col("dangling") & callsites.field("source-str").isNotNull()).select("rule", "dim", group_prefix(F.col("callsite_id")).alias("prefix"))
    several = found.groupBy("rule", "dim", "prefix").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    refs = declared_sites(entries).filter(~callsites.declares("filename")).withColumn("prefix", group_prefix(F.col("callsite_id")))
    return finding(refs.join(several, ["rule", "dim", "prefix"], "left_semi"), "warn", "ambiguous-callsite-reference", F.lit("the id is one of several equal callsites; its ordinal is a place"))


def dangling(merged: A.Merged) -> DataFrame:
    return finding(merged.sites.filter("dangling"), "warn", "dangling-callsite", F.lit("no layer has discovered this callsite; it annotates nothing"), layer="from_layer")


def no_ops(entries: DataFrame, bindings: DataFrame | symbols.Table | None = None) -> DataFrame:
    """Entries that repeat what the layers beneath them come to already, for all keys; what erases a key repeats nothing.

    A union of types repeats only the whole list so far, in its order; callsites only with the stamps that the merge gives them."""
    same = prefix.beneath(entries, bindings).filter("entry = beneath")
    return finding(same, "warn", "no-op-entry", F.concat("key", F.lit(" repeats the merged value beneath it")))


def derivation_drops(entries: DataFrame, bindings: DataFrame | symbols.Table | None = None) -> DataFrame:
    """Authored types that are lost if types come from callsites alone."""
    plain, strict = A.merge(entries, derivation="none", bindings=bindings), A.merge(entries, derivation="from-callsites", bindings=bindings)
    has = plain.detections.select("rule", "dim")
    lost = plain.types.join(has, ["rule", "dim"], "left_semi").select("rule", "dim", "type").distinct().join(strict.types.select("rule", "dim", "type").distinct(), ["rule", "dim", "type"], "left_anti")
    dim = F.when(F.col("key") == A.TYPES["insert"], "insert").when(F.col("key") == A.TYPES["retract"], "retract")
    origin = plain.provenance.select("rule", dim.alias("dim"), F.when(F.size("layers") == 1, F.col("layers")[0]).alias("layer"))
    rows = lost.join(origin, ["rule", "dim"], "left")
    return finding(rows, "warn", "derivation-dropped-authored-type", F.concat(F.lit("authored type "), "type", F.lit(" has no callsite to support it")))


def validate(entries: DataFrame, known: DataFrame | None = None, derivation: str = "additive", bindings: DataFrame | symbols.Table | None = None) -> DataFrame:
    """Distinct findings of all lints; unknown rules only if the known ones are given."""
    merged = A.merge(entries, derivation=derivation, bindings=bindings)
    out = no_ops(entries, bindings).unionByName(structure(entries)).unionByName(ambiguous(entries, merged)).unionByName(dangling(merged))
    if known is not None:
        out = out.unionByName(unknown_rules(entries, known))
    if derivation == "from-callsites":
        out = out.unionByName(derivation_drops(entries, bindings))
    return out.select(*FINDING).distinct()
