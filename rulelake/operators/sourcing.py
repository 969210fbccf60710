"""A source analysis from texts alone: definitions, usages, locals and what namespaces know names as.

Texts are walked one by one where they lie (functions/scopes.py); names get their namespaces by joins: a name with a part before
a slash belongs to the namespace that this part is an alias of, any other to its own namespace if that defines it, else to
the one it is taken over from, by name or with all others."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scopes
from ..runtime import cut, sized
from . import callgraph, symbols

_TYPES = {"string": pa.string(), "int": pa.int32()}


@dataclass(frozen=True, eq=False)
class Sourced:
    """Relations as a session has them, and definitions(ns, name, kind, filename, row, col, end_row, end_col)."""

    definitions: DataFrame
    usages: DataFrame
    locals: DataFrame
    local_usages: DataFrame
    records: DataFrame
    namespace_usages: DataFrame
    bindings: DataFrame
    aliases: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in ("usages", "locals", "local_usages", "records", "namespace_usages", "bindings", "aliases")}


def events(sources: DataFrame) -> DataFrame:
    """filename, id (of the event, unique) and scopes.EVENT of every text of sources(filename, text)."""
    fields = [x.split() for x in scopes.EVENT.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0), b.column(1), strict=True):
                found = list(scopes.events(text.as_py()))
                if found:
                    columns = [pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*found, strict=True), fields, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(found), pa.string()), *columns], names=["filename", *[k for k, _ in fields]])

    return sources.select("filename", "text").mapInArrow(rows, f"filename string, {scopes.EVENT}").withColumn("event", F.monotonically_increasing_id())


def namespace_texts(sources: DataFrame) -> DataFrame:
    """ns, filename, text: which text declares which namespace."""
    declared = events(sources).filter("kind = 'ns' and ns is not null").select("ns", "filename").distinct()
    return declared.join(sources.select("filename", "text"), "filename").select("ns", "filename", "text")


def class_name(ns, name):
    """The class that a record of a namespace is compiled to."""
    return F.concat(F.translate(ns, "-", "_"), F.lit("."), F.translate(name, "-", "_"))


def known(e: DataFrame, outside: tuple[str, ...] = callgraph.BOUNDARY) -> DataFrame:
    """bindings of variables: ns, symbol, kind, resolved (namespace/name): what a namespace defines, takes over by name, and
    takes over whole. outside: variables of namespaces without a text."""
    given = e.sparkSession.createDataFrame([tuple(x.split("/", 1)) for x in outside], "ns string, symbol string")
    defined = e.filter("kind = 'definition' and ns is not null").select("ns", F.col("name").alias("symbol")).unionByName(given).distinct()
    own = defined.select("ns", "symbol", F.lit("define").alias("kind"), F.concat("ns", F.lit("/"), "symbol").alias("resolved"))
    taken = e.filter("kind = 'refer'").select("ns", F.col("name").alias("symbol"), F.lit("refer").alias("kind"), F.col("target").alias("resolved"))
    whole = e.filter("kind = 'refer-all'").select(F.col("ns").alias("__ns"), F.col("target").alias("ns")).distinct().join(defined, "ns")
    whole = whole.select(F.col("__ns").alias("ns"), "symbol", F.lit("default").alias("kind"), F.concat("ns", F.lit("/"), "symbol").alias("resolved"))
    return own.unionByName(taken).unionByName(whole)


def read(sources: DataFrame) -> Sourced:
    """The analysis of sources(filename, text). Null and empty texts have none; of files that repeat, each row counts.

    A usage of a name that no text tells of has no `to`, unless it is written with its namespace. Records and imported classes
    are bindings of their namespaces; types of records are the classes they are compiled to."""
    e = cut(events(sources), "events")
    aliases = e.filter("kind = 'alias'").groupBy("ns", F.col("name").alias("alias")).agg(F.min("target").alias("target"))
    used = e.filter("kind = 'usage'")
    out = symbols.resolve(used, "name", "ns", symbols.Table(known(e), aliases))
    # a namespace that is written out may lie outside of these texts
    a = aliases.select(F.col("ns").alias("__ns"), F.col("alias").alias("__a"), F.col("target").alias("__target"))
    cut_at = F.instr("resolved", "/")
    there = F.when((cut_at > 1) & (cut_at < F.length("resolved")), F.substring_index("resolved", "/", 1))
    out = out.withColumn("__head", there).join(sized(a), (F.col("ns") == F.col("__ns")) & (F.col("__head") == F.col("__a")) & ~F.col("known"), "left")
    name = F.when(F.col("__head").isNotNull(), F.expr("substring(resolved, instr(resolved, '/') + 1)")).otherwise(F.col("resolved"))
    usages = out.select(F.col("event").alias("usage_id"), F.col("ns").alias("from"), F.col("var").alias("from_var"), F.coalesce("__target", "__head").alias("to"), name.alias("name"), "filename", "row", "col", "end_row", "end_col")

    records = e.filter("kind = 'definition' and target in ('defrecord', 'deftype') and ns is not null").select("ns", "name", F.lit("define").alias("kind"), class_name(F.col("ns"), F.col("name")).alias("type"))
    imports = e.filter("kind = 'import'").select("ns", "name", F.lit("import").alias("kind"), F.col("target").alias("type"))
    classes = cut(records.unionByName(imports).distinct(), "classes")
    place = ["filename", "id", "name", "row"]
    return Sourced(
        e.filter("kind = 'definition'").select("ns", "name", F.col("target").alias("kind"), "filename", "row", "col", "end_row", "end_col"),
        usages,
        e.filter("kind = 'local'").select("filename", F.col("id").cast("long").alias("id"), "name", "row", "end_col"),
        e.filter("kind = 'local-usage'").select("filename", F.col("id").cast("long").alias("id"), "name", "row", "col"),
        _reachable_records(classes, e, aliases),
        e.filter("kind in ('require', 'refer-all')").select(F.col("ns").alias("from"), F.col("target").alias("to")).distinct(),
        classes.select("ns", F.col("name").alias("symbol"), "kind", F.col("type").alias("resolved")),
        aliases,
    )


def _reachable_records(classes: DataFrame, e: DataFrame, aliases: DataFrame) -> DataFrame:
    """records(ns, name, type): classes by the names that constructors have in a namespace: its own and imported ones, those
    whose ->X it takes over, and alias/X."""
    own = classes.select("ns", "name", "type")
    made = classes.filter("kind = 'define'").select(F.col("ns").alias("__in"), F.col("name").alias("__x"), "type")
    taken = e.filter("kind = 'refer' and name rlike '^(map)?->.'").select("ns", F.regexp_replace("name", "^(map)?->", "").alias("name"), F.substring_index("target", "/", 1).alias("__in"), F.regexp_replace(F.expr("substring(target, instr(target, '/') + 1)"), "^(map)?->", "").alias("__x"))
    taken = taken.join(made, ["__in", "__x"]).select("ns", "name", "type")
    whole = e.filter("kind = 'refer-all'").select("ns", F.col("target").alias("__in")).join(made, "__in").select("ns", F.col("__x").alias("name"), "type")
    near = aliases.select("ns", "alias", F.col("target").alias("__in")).join(made, "__in").select("ns", F.concat("alias", F.lit("/"), "__x").alias("name"), "type")
    return own.unionByName(taken).unionByName(whole).unionByName(near).distinct()
