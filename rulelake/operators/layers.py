"""Ordered merge of sparse layers per (rule, key). entries(rule, key, pos, layer, value, tombstone); higher pos wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["rule", "key"]


def last_wins(entries: DataFrame) -> DataFrame:
    """The value of the highest layer; keys that end in a tombstone are gone. One aggregate, combined before the shuffle."""
    return entries.groupBy(*KEY).agg(F.max_by(F.struct("value", "layer", "tombstone"), "pos").alias("v")).filter("not v.tombstone").select(*KEY, "v.value", "v.layer")


def alive(entries: DataFrame, replaces: str | None = None) -> DataFrame:
    """Entries above the last tombstone of their key, and from the last replacement on."""
    reset = F.when(F.col("tombstone"), F.col("pos") + 1)
    if replaces:
        reset = F.when(F.col("tombstone"), F.col("pos") + 1).when(F.expr(replaces), F.col("pos"))
    last = entries.groupBy(*KEY).agg(F.coalesce(F.max(reset), F.lit(-(2**62))).alias("__from"))
    return entries.filter("not tombstone").join(last, KEY).filter("pos >= __from").drop("__from")


def union(entries: DataFrame, replaces: str | None = None) -> DataFrame:
    """values: distinct, in the order of their first layer and, within it, of `idx` if entries have one; provenance: the layers
    that contributed, lowest first."""
    live = alive(entries, replaces)
    place = F.struct("pos", "idx") if "idx" in entries.columns else F.col("pos")
    first = live.groupBy(*KEY, "value").agg(F.min(place).alias("p"))
    values = first.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "value"))), lambda x: x["value"]).alias("values"))
    seen = live.groupBy(*KEY, "layer").agg(F.min("pos").alias("p")).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "layer"))), lambda x: x["layer"]).alias("provenance"))
    return values.join(seen, KEY)


def appended(entries: DataFrame, separator: str = "\n") -> DataFrame:
    """Notes of all live layers, lowest first, joined."""
    return alive(entries).groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), separator).alias("notes"))


def delta(base: DataFrame, enriched: DataFrame) -> DataFrame:
    """(rule, key, value) rows that the enriched side adds."""
    return enriched.select(*KEY, "value").distinct().join(base.select(*KEY, "value").distinct(), [*KEY, "value"], "left_anti")


def no_op_entries(entries: DataFrame) -> DataFrame:
    """Entries that repeat what the layers beneath them already say, when the last wins."""
    w = W.partitionBy(*KEY).orderBy("pos")
    below = F.lag(F.struct("value", "tombstone")).over(w)
    return entries.withColumn("__b", below).filter("__b is not null and not __b.tombstone and not tombstone and value = __b.value").drop("__b")


def resolution(sites: DataFrame, by: list[str]) -> DataFrame:
    """full, none or partial, over the statuses of callsites."""
    s = F.col("status")
    return sites.groupBy(*by).agg(F.when(F.bool_and(s == "full"), "full").when(F.bool_and(s == "none"), "none").otherwise("partial").alias("resolution"), F.count("*").alias("n"))
