"""Texts of namespaces that own rules, assembled from rows: the text there is, or one made from what the namespace maps, then a
definition for each rule's right side under a tag of its own; and back from rows about these texts to the rules.

mappings(ns, kind, symbol, target): what a namespace maps. kind is alias (target: a namespace), refer (a variable), import (a
class), define, exclude (a core name it lacks), rename (a core name it has as symbol) or unmap (a class name that every
namespace has by default, but this one lacks). var_defs(ns, pos, name, form): definitions of variables that aren't rules.
A namespace's text is one row, as it is one file; its parts are aggregates of their own."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, scopes
from . import extract


@dataclass(frozen=True, eq=False)
class Combined:
    """texts(ns, filename, text, offset): offset is the last line before the rules. tags(ns, tag, production, row, end_row): which
    lines stand for which rule. skipped(ns, name, form, reason): definitions that were left out."""

    texts: DataFrame
    tags: DataFrame
    skipped: DataFrame


@F.pandas_udf(T.BooleanType())
def is_form(text: pd.Series) -> pd.Series:
    """Whether a text is one whole form."""
    return text.map(scopes.single)


def listed(rows: DataFrame, order: list[str], text: Column, between: str, name: str) -> DataFrame:
    """ns and the texts of its rows, in order, joined."""
    return rows.groupBy("ns").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("__text")))), lambda x: x["__text"]), between).alias(name))


def reconstructed(mappings: DataFrame, namespaces: DataFrame) -> DataFrame:
    """ns and head: a namespace form that maps the same, for each of namespaces(ns), and forms that take defaults away.

    Requirements come in the order of their namespaces, aliases before names, imports in the order of packages; classes of
    java.lang come by themselves. Rows that repeat count once."""
    m = mappings.filter("symbol is not null").distinct()
    core = listed(m.filter("kind = 'exclude'"), ["symbol"], F.col("symbol"), " ", "excluded")
    core = core.join(listed(m.filter("kind = 'rename' and target is not null"), ["target", "symbol"], F.concat_ws(" ", "target", "symbol"), " ", "renamed"), "ns", "full")
    some = lambda c, head, tail: F.when(F.col(c).isNotNull(), F.concat(F.lit(head), F.col(c), F.lit(tail)))
    core = core.select("ns", F.concat_ws(" ", F.lit("(:refer-clojure"), some("excluded", ":exclude [", "]"), some("renamed", ":rename {", "}")).alias("core"))
    aliases = m.filter("kind = 'alias' and target is not null").select("ns", "target", F.lit(0).alias("after"), "symbol", F.concat(F.lit("["), "target", F.lit(" :as "), "symbol", F.lit("]")).alias("clause"))
    refers = m.filter("kind = 'refer' and instr(target, '/') > 0").withColumn("target", F.substring_index("target", "/", 1)).filter("target <> 'clojure.core'")
    refers = refers.groupBy("ns", "target").agg(F.array_join(F.array_sort(F.collect_set("symbol")), " ").alias("symbols"))
    refers = refers.select("ns", "target", F.lit(1).alias("after"), F.lit("").alias("symbol"), F.concat(F.lit("["), "target", F.lit(" :refer ["), "symbols", F.lit("]]")).alias("clause"))
    requires = listed(aliases.unionByName(refers), ["target", "after", "symbol"], F.col("clause"), " ", "requires")
    imports = m.filter("kind = 'import' and instr(target, '.') > 0").withColumn("package", F.regexp_replace("target", r"\.[^.]*$", "")).filter("package <> 'java.lang'")
    imports = imports.groupBy("ns", "package").agg(F.array_join(F.array_sort(F.collect_set("symbol")), " ").alias("classes"))
    imports = listed(imports, ["package"], F.concat(F.lit("["), "package", F.lit(" "), "classes", F.lit("]")), " ", "imports")
    gone = listed(m.filter("kind = 'unmap'"), ["symbol"], F.concat(F.lit("(ns-unmap (the-ns '"), "ns", F.lit(") '"), "symbol", F.lit(")\n")), "", "gone")
    rows = namespaces.select("ns").distinct()
    for d in (core, requires, imports, gone):
        rows = rows.join(d, "ns", "left")
    form = F.concat_ws(" ", F.concat(F.lit("(ns "), "ns"), some("core", "", ")"), some("requires", "(:require ", ")"), some("imports", "(:import ", ")"))
    return rows.select("ns", F.concat(form, F.lit(")\n"), F.coalesce("gone", F.lit(""))).alias("head"))


def definitions(var_defs: DataFrame, productions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ns and defs (a line for each definition, in order), and the definitions that are left out: of a rule's name (silently), in
    several lines, or not one whole form."""
    known = productions.select("ns", names.local_name(F.col("name")).alias("name")).distinct()
    own = var_defs.join(known, ["ns", "name"], "left_anti").filter("ns is not null and form is not null")
    reason = F.when(F.instr("form", "\n") > 0, "multiline").when(~is_form("form"), "unreadable")
    own = own.withColumn("reason", reason)
    return listed(own.filter("reason is null"), ["pos", "name"], F.concat("form", F.lit("\n")), "", "defs"), own.filter("reason is not null").select("ns", "name", "form", "reason")


def n_lines(text: Column) -> Column:
    """Lines of a text, without empty ones at its end."""
    return F.size(F.split(F.regexp_replace(text, "\n+$", ""), "\n", -1))


def combined(productions: DataFrame, base: DataFrame, mappings: DataFrame, var_defs: DataFrame) -> Combined:
    """The texts of namespaces that own rules. productions as a session's; base(ns, filename, text): texts that there are; of
    several of a namespace the first by filename stays.

    A namespace without a text gets one from its mappings, with declarations of what it defines and isn't a rule, and its
    definitions. Rules without a namespace or a right side are left out; of rules that repeat a name each has its lines."""
    p = extract.with_namespace(productions)
    rules = p.filter("kind = 'rule' and ns is not null and rhs is not null")
    owners = rules.select("ns").distinct()
    real = base.filter("text is not null").groupBy("ns").agg(F.min(F.struct("filename", "text")).alias("v")).select("ns", "v.*")
    known = p.select("ns", names.local_name(F.col("name")).alias("symbol")).distinct()
    declared = mappings.filter("kind = 'define' and symbol is not null").select("ns", "symbol").distinct().join(known, ["ns", "symbol"], "left_anti")
    declared = declared.groupBy("ns").agg(F.concat(F.lit("(declare "), F.array_join(F.array_sort(F.collect_list("symbol")), " "), F.lit(")\n")).alias("declared"))
    defs, skipped = definitions(var_defs, p)
    bare = owners.join(real, "ns", "left_anti")
    made = reconstructed(mappings, bare).join(declared, "ns", "left").join(defs, "ns", "left")
    made = made.select("ns", F.concat(names.resource_path(F.col("ns")), F.lit(".clj")).alias("filename"), F.concat("head", F.coalesce("declared", F.lit("")), F.coalesce("defs", F.lit(""))).alias("text"))
    head = owners.join(real, "ns").select("ns", "filename", "text").unionByName(made)

    at = W.partitionBy("ns").orderBy("prod_ord", "name")
    tag = F.concat(F.lit("__rule_"), (F.row_number().over(at) - 1).cast("string"), F.lit("__"))
    snippets = rules.select("ns", "prod_ord", "name", "rhs", tag.alias("tag")).withColumn("form", F.concat(F.lit("(def "), "tag", F.lit(" (fn [] "), "rhs", F.lit("))")))
    lines = F.length("form") - F.length(F.replace("form", F.lit("\n"), F.lit(""))) + 1
    snippets = snippets.withColumn("lines", lines).withColumn("before", F.coalesce(F.sum("lines").over(at.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    body = listed(snippets, ["prod_ord", "name", "tag"], F.concat("form", F.lit("\n")), "", "body")
    texts = head.join(body, "ns").select("ns", "filename", F.concat("text", F.lit("\n"), "body").alias("text"), n_lines(F.col("text")).alias("offset"))
    first = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 2
    tags = snippets.join(head.select("ns", first.alias("first")), "ns")
    tags = tags.select("ns", "tag", names.local_name(F.col("name")).alias("production"), (F.col("first") + F.col("before")).cast("int").alias("row"), (F.col("first") + F.col("before") + F.col("lines") - 1).cast("int").alias("end_row"))
    return Combined(texts, tags, skipped)


def all_texts(sources: DataFrame, made: Combined) -> DataFrame:
    """sources(filename, text) in which assembled texts stand for those they were made from."""
    new = made.texts.select("filename", "text")
    return sources.select("filename", "text").join(new.select("filename"), "filename", "left_anti").unionByName(new)


def pruned_usages(usages: DataFrame, productions: DataFrame, made: Combined) -> DataFrame:
    """usages as if rules were written as they are: what lies in a known production's own definition goes, and what lies in a
    tagged one belongs to its rule."""
    p = extract.with_namespace(productions)
    known = p.filter("ns is not null").select("ns", names.local_name(F.col("name")).alias("name"))
    rows = usages.withColumnsRenamed({"name": "__used", "from": "ns", "from_var": "name"})
    out = extract.pruned(rows, made.texts.select("ns", "offset"), made.tags.select("ns", "tag", "production"), known)
    return out.withColumnsRenamed({"ns": "from", "name": "from_var", "__used": "name"}).select(*usages.columns)
