"""Sessions and rulebases as tables in a folder, annotation layers as JSON, and the export tree.

A session folder holds a table per relation, NAME.parquet or NAME.json (a JSON object a line): productions, ancestors, nodes; of
working memory facts, activations, matches, insertions; of source analysis usages, sources, locals, local_usages, records,
namespace_usages; of names bindings and aliases; to assemble texts mappings
and var_defs. Any may be missing. Facts may lie in a folder of their own."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import annotations as A
from ..operators import symbols

SCHEMAS = {
    "productions": "prod_ord int, name string, ns string, kind string, doc string, props map<string,string>, params array<string>, lhs string, rhs string",
    "ancestors": "type string, ancestor string",
    "nodes": "id string, kind string, children array<string>, name string, detail string",
    "facts": "uid long, type string, ns string, data string, root boolean",
    "activations": "activation long, prod string, bindings string",
    "matches": "activation long, uid long, accumulated array<long>",
    "insertions": "seq long, prod string, uid long",
    "usages": "usage_id long, `from` string, from_var string, `to` string, name string, filename string, row int, col int, end_row int, end_col int",
    "sources": "filename string, text string",
    "locals": "filename string, id long, name string, row int, end_col int",
    "local_usages": "filename string, id long, name string, row int, col int",
    "records": "ns string, name string, type string",
    "namespace_usages": "`from` string, `to` string",
    "bindings": "ns string, symbol string, kind string, resolved string",
    "aliases": "ns string, alias string, target string",
    "mappings": "ns string, kind string, symbol string, target string",
    "elements": "node string, uid long, bindings string",
    "tokens": "node string, token long, pos int, uid long, bindings string",
    "var_defs": "ns string, pos int, name string, form string",
}
MEMORY = ("facts", "activations", "matches", "insertions", "elements", "tokens")
LAYER = "id string, source string, notes string, `merge-props` map<string,string>, annotations map<string,map<string,string>>"


@dataclass(frozen=True, eq=False)
class Session:
    """Relations by name; `tables` has those that exist. Two loads are two sessions, even of the same folder."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        """The relation, empty if there is none."""
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], SCHEMAS[name])

    @property
    def working_memory(self) -> bool:
        return "facts" in self.tables

    @property
    def names(self) -> symbols.Table | None:
        """What namespaces know names as, if the session tells."""
        return symbols.Table(self["bindings"], self["aliases"]) if {"bindings", "aliases"} & set(self.tables) else None

    def rulebase(self) -> Session:
        """The same without working memory."""
        return Session(self.spark, {k: v for k, v in self.tables.items() if k not in MEMORY})


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def facts_path(session: str, facts: str | None = None) -> str:
    """Where facts lie if they aren't in the session's folder."""
    return facts or session.rstrip("/") + ".facts"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    schema = SCHEMAS[name]
    if exists(spark, f"{folder}/{name}.parquet"):
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        wanted = spark.createDataFrame([], schema).schema
        return rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
    if exists(spark, f"{folder}/{name}.json"):
        return spark.read.schema(schema).json(f"{folder}/{name}.json")
    return None


def load_session(spark: SparkSession, path: str, facts: str | None = None, loader: str | Callable | None = None) -> Session:
    """The relations of a session folder. loader (a callable or its dotted name) takes (spark, path, facts path) and returns
    them by name instead. A folder without productions is an error."""
    beside = facts_path(path, facts)
    if loader is not None:
        tables = resolve(loader)(spark, path, beside)
    else:
        tables = {}
        for name in SCHEMAS:
            found = read_table(spark, beside, name) if name in MEMORY and exists(spark, beside) else None
            found = found if found is not None else read_table(spark, path, name)
            if found is not None:
                tables[name] = found
    if "productions" not in tables:
        raise FileNotFoundError(f"no productions in {path}")
    return Session(spark, tables)


def resolve(name: str | Callable) -> Callable:
    """package.module.function or package.module:function."""
    if callable(name):
        return name
    module, _, attribute = name.replace(":", ".").rpartition(".")
    return getattr(importlib.import_module(module), attribute)


def read_layers(spark: SparkSession, paths: list[str], first: int = 1, **given: str) -> DataFrame:
    """Entries of layers in files of one JSON object each, lowest first, placed from `first` on. Without an id a layer is
    called by its path. A file that is missing or isn't a layer is an error. given (id, source) overrides what files say."""
    every = spark.createDataFrame([], A.ENTRIES)
    for i, path in enumerate(paths):
        if not exists(spark, path):
            raise FileNotFoundError(path)
        row = spark.read.text(path, wholetext=True).select(F.from_json("value", LAYER).alias("l")).select("l.*")
        if not row.filter("annotations is not null").count():
            raise ValueError(f"{path} is no layer: it has no annotations")
        every = every.unionByName(entries_of(row, first + i, given.get("id"), path))
    return every


def entries_of(layers: DataFrame, pos: int | Column, ident: str | None = None, otherwise: str | None = None) -> DataFrame:
    """Entries of rows of LAYER."""
    name = F.coalesce(F.lit(ident), F.col("id"), F.lit(otherwise), F.lit("layer"))
    at = pos if isinstance(pos, Column) else F.lit(pos)
    rows = layers.select(at.cast("int").alias("layer_pos"), name.alias("layer"), F.coalesce("merge-props", F.create_map().cast("map<string,string>")).alias("props"), F.explode("annotations").alias("rule", "keys"))
    rows = rows.select("layer_pos", "layer", F.regexp_replace("rule", "^:", "").alias("rule"), F.explode("keys").alias("key", "value"), "props")
    return rows.select("layer_pos", "layer", "rule", "key", "value", "props")


def layer_of(spark: SparkSession, annotations: dict, layer: str = "source", pos: int = 1, props: dict | None = None) -> DataFrame:
    """Entries of a layer that is at hand as {rule: {key: value}}; None erases a key."""
    import json

    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    rows = [(pos, layer, str(rule).lstrip(":"), key, text(value), {k: str(v) for k, v in (props or {}).items()}) for rule, keys in annotations.items() for key, value in keys.items()]
    return spark.createDataFrame(rows, A.ENTRIES)


def write_layer(entries: DataFrame, path: str) -> None:
    """One JSON object per rule, its keys to texts: what read_layer_rows reads."""
    rows = entries.groupBy("layer_pos", "layer", "rule").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("keys"), F.first("props").alias("props"))
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_layer_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("layer_pos int, layer string, rule string, keys map<string,string>, props map<string,string>").json(path)
    return rows.select("layer_pos", "layer", "rule", F.explode("keys").alias("key", "value"), F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))


REF = "struct<name:string,id:string,known:boolean>"
DEP = f"array<struct<ns:string,name:string,id:string,type:string,match:array<struct<`producer-type`:{REF},`consumer-type`:{REF},via:string>>>>"
EXPORT_PRODUCTION = f"name string, id string, ns string, doc string, notes string, params array<string>, props map<string,string>, lhs string, `lhs-types` array<{REF}>, `insert-types` array<{REF}>, `retract-types` array<{REF}>, `source-rule` boolean, `sink-rule` boolean, upstream {DEP}, downstream {DEP}, `rhs-form` string"
EXPORT_TYPE = f"name string, id string, ns string, ancestors array<{REF}>, descendants array<{REF}>, `used-by-rules` {DEP}, `used-by-queries` {DEP}, `inserted-by-rules` {DEP}, `retracted-by-rules` {DEP}"
EXPORT_FACT = f"id long, type {REF}, ns string, data string, `is-root` boolean, `inserted-from` {DEP}, `used-by` {DEP}"
EXPORTS = {"rules": EXPORT_PRODUCTION, "queries": EXPORT_PRODUCTION, "fact-types": EXPORT_TYPE, "session/facts": EXPORT_FACT}


def read_export(spark: SparkSession, root: str, resource: str, schema: str | T.StructType | None = None) -> DataFrame:
    """All objects of a resource of an exported tree, whether written by write_export or a file of JSON each (resource/ID.json)."""
    kind = schema or EXPORTS[resource]
    if exists(spark, f"{root}/resource={resource.replace('/', '%2F')}"):
        rows = spark.read.schema("value string, resource string, id string").text(root).filter(F.col("resource") == resource)
        return rows.select(F.from_json("value", kind).alias("v")).select("v.*")
    return spark.read.schema(kind).json(f"{root}/{resource}/*.json", multiLine=True)


def export_location(route: str, root: str) -> str:
    """Where the export tree keeps the answers of a route: a folder for each resource, and in it one for each id."""
    resource, _, ident = route.removeprefix("/v1/").strip("/").rpartition("/")
    whole = lambda x: x.replace("/", "%2F")
    if resource in ("", "session"):  # a list, or a summary
        resource, ident = f"{resource}/{ident}".lstrip("/"), ""
    return f"{root.rstrip('/')}/resource={whole(resource)}" + (f"/id={ident}" if ident else "")


def write_export(answers: dict[str, DataFrame], root: str) -> None:
    """One job: the rows of each resource as JSON texts in a folder by resource and id. Rows without an id are in one folder.

    Each id's rows are written by one task; a resource is dealt over all."""
    every = None
    for resource, rows in answers.items():
        ident = F.coalesce(F.col("id").cast("string"), F.lit("none")) if "id" in rows.columns else F.lit("all")
        some = rows.select(F.lit(resource).alias("resource"), ident.alias("__id"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value"))
        every = some if every is None else every.unionByName(some)
    if every is not None:
        every.withColumnRenamed("__id", "id").repartition("resource", "id").write.mode("overwrite").partitionBy("resource", "id").text(root)
