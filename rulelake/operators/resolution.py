"""What types a rule's insertions and retractions make, from its source: arguments of boundary calls are traced through locals,
constructors that a caller declares own the arguments they reach, the rest is read from constructor forms or asked of a
resolver, and where nothing is found, constructors anywhere beneath stand in.

usages(usage_id, from, from_var, to, name, filename, row, col, end_row, end_col); sources(filename, text); locals(filename, id,
row, end_col); local_usages(filename, id, name, row, col); records(ns, name, type): what a class name, as it is written in a
namespace, stands for."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import forms
from ..runtime import cut
from . import callgraph, callsites

#: How many locals are followed one after the other.
DEPTH = 8
SYMBOL = r"^[^\s()\[\]{}\"'`~@^;:,0-9][^\s()\[\]{}\"'`~@^;,]*$"
#: Rows of source in one bucket of the containment join.
ROWS = 64


def at(row: Column, col: Column) -> Column:
    """A place in a file as one number."""
    return row.cast("long") * F.lit(1 << 20) + col


def encloses(outer: DataFrame, inner: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs of an outer span (filename, row, col, end_row, end_col) and an inner place (filename, i_row, i_col) inside it,
    both ends included. Rows with a null in any of these match nothing.

    An equi join on the file and a bucket of rows, then a comparison: not every pair of a file is looked at."""
    span = F.sequence(F.floor(F.col("row") / ROWS), F.floor(F.col("end_row") / ROWS))
    o = outer.filter("filename is not null and row is not null and col is not null and end_col is not null and end_row >= row").withColumn("__b", F.explode(span))
    i = inner.filter("filename is not null and i_row is not null and i_col is not null").withColumnRenamed("filename", "__f").withColumn("__c", F.floor(F.col("i_row") / ROWS))
    inside = (at(F.col("row"), F.col("col")) <= at(F.col("i_row"), F.col("i_col"))) & (at(F.col("i_row"), F.col("i_col")) <= at(F.col("end_row"), F.col("end_col")))
    return o.join(i, (F.col("filename") == F.col("__f")) & (F.col("__b") == F.col("__c")) & inside, how).drop("__b", "__c", "__f")


def with_lines(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(sources.select("filename", F.split("text", "\n", -1).alias("lines")), "filename", "left")


def arguments(usages: DataFrame, sources: DataFrame) -> DataFrame:
    """usages' columns, idx and arg: each argument of each call, as it is written."""
    text = with_lines(usages, sources).withColumn("text", forms.read_span("lines", "row", "col", "end_row", "end_col")).drop("lines")
    return text.select("*", F.posexplode(forms.read_arguments("text")).alias("idx", "arg")).drop("text")


def traced(args: DataFrame, sources: DataFrame, locals_: DataFrame, local_usages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """args with form (the innermost form that the argument is bound to, else itself), and init_row, init_col: where it begins,
    null if no local was followed.

    Each round follows the arguments that are still names: their use inside the call, in the same file, the binding with that
    use's id, and the form after it. Rounds end when none is left, or after `depth`."""
    now = args.withColumns({"form": F.col("arg"), "init_row": F.lit(None).cast("int"), "init_col": F.lit(None).cast("int")})
    done = None
    names_ = ["usage_id", "idx"]
    uses = local_usages.select("filename", F.col("name").alias("form"), F.col("id").alias("local_id"), F.col("row").alias("u_row"), F.col("col").alias("u_col"))
    bound = with_lines(locals_.select("filename", F.col("id").alias("local_id"), F.col("row").alias("b_row"), F.col("end_col").alias("b_col")), sources)
    bound = bound.withColumn("init", forms.read_init("lines", "b_row", "b_col")).filter("init.form is not null").select("filename", "local_id", "init")
    for _ in range(depth):
        open_ = now.filter(F.col("form").rlike(SYMBOL))
        use = F.struct("u_row", "u_col", "local_id")
        inside = (at(F.col("row"), F.col("col")) <= at(F.col("u_row"), F.col("u_col"))) & (at(F.col("u_row"), F.col("u_col")) < at(F.col("end_row"), F.col("end_col")))
        first = open_.join(uses, ["filename", "form"]).filter(inside).groupBy("filename", *names_).agg(F.min(use).alias("u")).select("filename", *names_, F.col("u.local_id").alias("local_id"))
        found = cut(first.join(bound, ["filename", "local_id"]).select(*names_, "init"), "locals")
        if not found.limit(1).count():
            break
        rest = now.join(found.select(*names_), names_, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        now = cut(now.join(found, names_).withColumns({"form": F.col("init.form"), "init_row": F.col("init.row"), "init_col": F.col("init.col")}).drop("init"), "traced")
    return now if done is None else done.unionByName(now)


def hook(f: Callable[[dict], list[str] | None]) -> Callable[[Column], Column]:
    """A caller's function over a context as a column of types. What it raises is contained: that row stays unresolved."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def call(context: pd.DataFrame) -> pd.Series:
        def one(row: dict) -> list[str] | None:
            try:
                out = f(row)
                return sorted(set(map(str, out))) if out else None
            except Exception:  # a caller's code; the contract is that a failure means unresolved
                return None

        return pd.Series([one(r) for r in context.to_dict("records")], dtype=object)

    return call


def owners(args: DataFrame, ctors: DataFrame, siblings: DataFrame, links: DataFrame) -> DataFrame:
    """inserter, ctor_id, usage_id, idx: the first argument (in source order) that reaches each constructor call.

    An argument reaches it if the call encloses it; if the local that the argument stands for begins exactly there; or if
    another call inside it names a link of the path to it. Arguments met through an alias never do.
    args: of traced, with caller and alias; ctors(inserter, ctor_id, filename, row, col); siblings(caller, callee, filename,
    row, col); links(inserter, ctor_id, link)."""
    a = args.filter("not alias").select(F.col("caller").alias("inserter"), "usage_id", "idx", "filename", "row", "col", "end_row", "end_col", "init_row", "init_col")
    c = ctors.select("inserter", "ctor_id", "filename", F.col("row").alias("i_row"), F.col("col").alias("i_col"))
    same = lambda d: d.select("inserter", "ctor_id", "usage_id", "idx", "row", "col")
    calls = a.select("inserter", "usage_id", "filename", "row", "col", "end_row", "end_col").distinct()
    inside = encloses(calls, c.withColumnRenamed("inserter", "__i")).filter("inserter = __i").select("inserter", "ctor_id", "usage_id").distinct()
    bound = a.filter("init_row is not null").join(c, ["inserter", "filename"]).filter("init_row = i_row and init_col = i_col")
    s = siblings.select(F.col("caller").alias("__i"), F.col("callee").alias("link"), "filename", F.col("row").alias("i_row"), F.col("col").alias("i_col"))
    through = encloses(calls, s).filter("inserter = __i").select("inserter", "usage_id", "link").distinct().join(links, ["inserter", "link"]).select("inserter", "ctor_id", "usage_id").distinct()
    near = a.join(inside.unionByName(through).distinct(), ["inserter", "usage_id"])
    every = same(near).unionByName(same(bound)).distinct()
    return every.groupBy("inserter", "ctor_id").agg(F.min(F.struct("row", "col", "usage_id", "idx")).alias("v")).select("inserter", "ctor_id", "v.usage_id", "v.idx")


def handled(args: DataFrame, owned: DataFrame, resolved: DataFrame) -> DataFrame:
    """caller: variables of which some argument is owned or resolved; they need no guess."""
    some = owned.select("usage_id", "idx").unionByName(resolved.select("usage_id", "idx")).distinct()
    return args.join(some, ["usage_id", "idx"], "left_semi").select("caller").distinct()


def admitted(types: DataFrame, read: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Rows of types(type, ..) whose type, or an ancestor of it, is on some left side. read(type)."""
    up = ancestors.select("type", "ancestor").join(read.select(F.col("type").alias("ancestor")).distinct(), "ancestor", "left_semi").select("type")
    return types.join(up.unionByName(read.select("type")).distinct(), "type", "left_semi")


def _sites(rows: DataFrame, **fields: Column) -> Column:
    pairs = F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def infer(
    rules: DataFrame,
    usages: DataFrame,
    sources: DataFrame,
    locals_: DataFrame,
    local_usages: DataFrame,
    records: DataFrame,
    specs: DataFrame | None = None,
    spec_resolver: Callable[[dict], list[str] | None] | None = None,
    resolver: Callable[[dict], list[str] | None] | None = None,
    aliases: DataFrame | None = None,
    read: DataFrame | None = None,
    ancestors: DataFrame | None = None,
    fallback: bool = True,
) -> DataFrame:
    """rule, dim, pos, callsite_id, fields and types of every callsite that rules(rule) reach.

    specs(pattern, spec) declare constructors, whose types spec_resolver tells; resolver is asked what the forms don't tell;
    aliases(rule, caller, type, var) of callgraph.alias_contexts; read and ancestors limit the fallback to types that some
    left side reads. Without an insertion or retraction a rule has no row."""
    spark = rules.sparkSession
    named = cut(usages.withColumns({"caller": callgraph.qualified(F.col("from"), F.col("from_var")), "callee": callgraph.qualified(F.col("to"), F.col("name"))}), "usages")
    graph = cut(callgraph.calls(usages), "calls")
    near = cut(callgraph.reachable(graph, rules.select("rule"), callgraph.BOUNDARY, itself=True).toDF("rule", "node"), "near")
    dim = F.when(F.col("callee").isin(*callgraph.INSERTS), "insert").when(F.col("callee").isin(*callgraph.RETRACTS), "retract")
    boundary = named.withColumn("dim", dim).filter("dim is not null and caller is not null")
    targets = F.when(F.col("dim") == "insert", F.col("caller").isin(*callgraph.INSERTS)).otherwise(F.col("caller").isin(*callgraph.RETRACTS))
    boundary = boundary.filter(~targets)
    per_rule = near.join(boundary, F.col("node") == F.col("caller")).select("rule", "usage_id")
    args = traced(arguments(boundary, sources), sources, locals_, local_usages)
    args = cut(args.join(per_rule, "usage_id"), "args")
    if aliases is not None:
        args = args.join(aliases.select("rule", "caller", F.col("type").alias("fact_type"), "var"), ["rule", "caller"], "left").withColumn("alias", F.col("var").isNotNull())
    else:
        args = args.withColumns({"fact_type": F.lit(None).cast("string"), "alias": F.lit(False)})

    inserters = boundary.select("caller", "dim").distinct()
    subtrees = callgraph.reachable(graph, inserters.select("caller").distinct(), callgraph.BOUNDARY, itself=True).toDF("inserter", "node")
    subtrees = cut(subtrees, "subtrees")
    paths = callgraph.shortest_paths(graph, rules.select(F.col("rule").alias("start")).unionByName(inserters.select(F.col("caller").alias("start"))).distinct())
    paths = cut(paths, "paths")

    def steps(path: Column) -> Column:
        return F.to_json(F.transform(path, lambda v: F.struct(v.alias("var-name-sym"))))

    to_rule = paths.filter("start <> node").select(F.col("start").alias("rule"), F.col("node").alias("caller"), F.col("path").alias("rule_path"))

    # declared constructors own the arguments they are reached through
    owned = spark.createDataFrame([], "rule string, dim string, usage_id long, idx int, ctor string, types array<string>, source string, ns string, file string, c_row int, c_col int, path array<string>, boundary string, caller string")
    dropped = spark.createDataFrame([], "usage_id long, idx int, ctor string, path array<string>")
    if specs is not None and spec_resolver is not None:
        found = callgraph.spec_usages(subtrees, named, specs).withColumn("ctor_id", F.col("usage_id"))
        to_ctor = paths.select(F.col("start").alias("inserter"), F.col("node").alias("caller"), F.col("path"))
        found = cut(found.join(to_ctor, ["inserter", "caller"]), "ctors")
        links = found.select("inserter", "ctor_id", F.explode(F.slice("path", F.lit(2), F.greatest(F.lit(0), F.size("path") - 1))).alias("link"))
        own = owners(args.dropDuplicates(["usage_id", "idx"]), found, named.filter("caller is not null"), links)
        text = with_lines(found, sources).withColumn("source", forms.read_span("lines", "row", "col", "end_row", "end_col")).select("inserter", "ctor_id", F.col("callee").alias("ctor"), "source", F.col("from").alias("ns"), F.col("filename").alias("file"), F.col("row").alias("c_row"), F.col("col").alias("c_col"), "path", "spec")
        rows = own.join(text, ["inserter", "ctor_id"])
        calls = boundary.select("usage_id", "dim", F.col("callee").alias("boundary"), "caller")
        rows = rows.join(calls, "usage_id")
        context = F.struct("spec", "ctor", F.col("source").alias("arg_form"), "ns", F.col("file").alias("filename"), F.col("dim").alias("direction"))
        rows = cut(rows.withColumn("types", hook(spec_resolver)(context)), "owners")
        done = rows.filter("types is not null").join(per_rule, "usage_id")
        owned = done.select(*owned.columns)
        lost = rows.filter("types is null").groupBy("usage_id", "idx").agg(F.count("*").alias("n"), F.first("ctor").alias("ctor"), F.first("path").alias("path")).filter("n = 1")
        dropped = lost.select("usage_id", "idx", "ctor", "path")

    rest = args.join(owned.select("rule", "usage_id", "idx").distinct(), ["rule", "usage_id", "idx"], "left_anti").withColumn("built", forms.read_class("form"))
    typed = rest.join(records.select(F.col("ns").alias("from"), F.col("name").alias("built"), F.col("type").alias("record")), ["from", "built"], "left")
    types = F.when(~F.col("alias") & F.col("record").isNotNull(), F.array("record"))
    if resolver is not None:
        context = F.struct("rule", F.col("from").alias("ns"), F.col("dim").alias("direction"), F.col("callee").alias("boundary_fn"), F.col("form").alias("arg_form"), "filename", "fact_type")
        types = F.coalesce(types, hook(resolver)(context))
    typed = cut(typed.withColumn("types", types), "typed").join(dropped.withColumnRenamed("path", "ctor_path"), ["usage_id", "idx"], "left")
    none = F.lit(None)
    status = F.when(F.size(F.coalesce("types", F.array().cast("array<string>"))) > 0, "full").otherwise("none")

    def route(boundary_fn: Column, caller: Column, rule_path: Column, ctor_path: Column) -> Column:
        return F.to_json(F.struct(boundary_fn.alias("boundary-var-name-sym"), caller.alias("boundary-in-var"), F.transform(rule_path, lambda v: F.struct(v.alias("var-name-sym"))).alias("rule-to-boundary-path"), F.transform(ctor_path, lambda v: F.struct(v.alias("var-name-sym"))).alias("boundary-to-constructor-path")))

    with_path = typed.join(to_rule, ["rule", "caller"], "left")
    whole = F.when(F.col("ctor").isNotNull(), F.array_append("ctor_path", F.col("ctor")))
    plain = with_path.withColumn("status", status)
    plain = plain.select("rule", "dim", F.struct(F.lit(1).alias("k"), F.coalesce("filename", F.lit("")).alias("f"), "row", "col", "idx").alias("at"), _sites(plain, source_str=F.col("arg"), ns_name_sym=F.col("from"), filename=F.col("filename"), status=F.col("status"), resolved_types=F.when(F.col("types").isNotNull(), F.to_json("types")), fact_type=F.col("fact_type"), constructor_sym=F.col("ctor"), via=route(F.col("callee"), F.col("caller"), F.col("rule_path"), whole)).alias("fields"), F.coalesce("types", F.array().cast("array<string>")).alias("types"))
    made = owned.join(to_rule, ["rule", "caller"], "left")
    made = made.select("rule", "dim", F.struct(F.lit(0).alias("k"), F.coalesce("file", F.lit("")).alias("f"), F.col("c_row").alias("row"), F.col("c_col").alias("col"), "idx").alias("at"), _sites(made, source_str=F.col("source"), ns_name_sym=F.col("ns"), filename=F.col("file"), constructor_sym=F.col("ctor"), status=F.lit("full"), resolved_types=F.to_json("types"), via=route(F.col("boundary"), F.col("caller"), F.col("rule_path"), F.array_append("path", F.col("ctor")))).alias("fields"), "types")
    every = plain.unionByName(made)

    if fallback:
        solved = typed.filter("types is not null").select("rule", "usage_id", "idx")
        seen = args.join(owned.select("rule", "usage_id", "idx").unionByName(solved).distinct(), ["rule", "usage_id", "idx"], "left_semi").select("rule", "dim", "caller").distinct()
        guess = callgraph.earliest_usages(subtrees, named, records)
        if read is not None:
            guess = admitted(guess, read, ancestors if ancestors is not None else spark.createDataFrame([], "type string, ancestor string"))
        open_ = near.join(inserters, F.col("node") == F.col("caller")).select("rule", "dim", "caller").join(seen, ["rule", "dim", "caller"], "left_anti")
        fn = boundary.groupBy(F.col("caller").alias("inserter"), "dim").agg(F.min("callee").alias("boundary"))
        scan = open_.withColumnRenamed("caller", "inserter").join(guess, "inserter").join(fn, ["inserter", "dim"], "left")
        via = F.to_json(F.struct(F.lit("record-ctor-scan").alias("source"), F.col("boundary").alias("boundary-var-name-sym")))
        scan = scan.select("rule", "dim", F.struct(F.lit(2).alias("k"), F.concat("inserter", F.lit(" "), "type").alias("f"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(0).alias("idx")).alias("at"), _sites(scan, source_str=F.col("usage.name"), ns_name_sym=F.substring_index("usage.caller", "/", 1), filename=F.col("usage.filename"), status=F.lit("full"), resolved_types=F.to_json(F.array("type")), via=via).alias("fields"), F.array("type").alias("types"))
        every = every.unionByName(scan)

    # the same entry twice is one
    every = every.withColumn("__text", F.to_json(F.array_sort(F.map_entries("fields")))).groupBy("rule", "dim", "__text").agg(F.min("at").alias("at"), F.first("fields").alias("fields"), F.first("types").alias("types")).drop("__text")
    every = every.withColumns({"ns": callsites.field("ns-name-sym"), "ctor": callsites.field("constructor-sym"), "source": callsites.field("source-str")})
    every = callsites.assign_ids(every, ["rule", "dim"], ["at"])
    return every.withColumn("pos", F.row_number().over(W.partitionBy("rule", "dim").orderBy("at")) - 1).select("rule", "dim", "pos", "callsite_id", "fields", "types")


def entries(sites: DataFrame, rules: DataFrame, layer: str = "generated", layer_pos: int = 1) -> DataFrame:
    """Layer entries of inferred callsites: sorted types and detections, and no-output-types of rules that reach nothing."""
    from . import annotations as A

    key = lambda table: F.when(F.col("dim") == "insert", table["insert"]).otherwise(table["retract"])
    types = sites.select("rule", "dim", F.explode("types").alias("t")).distinct().groupBy("rule", "dim").agg(F.to_json(F.array_sort(F.collect_list("t"))).alias("value")).select("rule", key(A.TYPES).alias("key"), "value")
    named = F.map_concat(F.create_map(F.lit("callsite-id"), F.col("callsite_id")), "fields")
    listed = sites.groupBy("rule", "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json(named).alias("s")))), lambda x: x["s"]).alias("callsites"))
    found = listed.select("rule", key(A.DETECTIONS).alias("key"), F.concat(F.lit('{"callsites":['), F.array_join("callsites", ","), F.lit("]}")).alias("value"))
    silent = rules.select("rule").distinct().join(sites.select("rule"), "rule", "left_anti").select("rule", F.lit("no-output-types").alias("key"), F.lit("true").alias("value"))
    return A.as_layer(types.unionByName(found).unionByName(silent), layer, layer_pos)


def provenance_chain(rule: Column, via: Column) -> Column:
    """[{label, sym}]: rule, callers, boundary, callers and the constructor of a traced route (JSON); null for a scanned one."""
    step = "array<struct<`var-name-sym`:string>>"
    v = F.from_json(via, f"`boundary-var-name-sym` string, `boundary-in-var` string, `rule-to-boundary-path` {step}, `boundary-to-constructor-path` {step}")
    empty = F.array().cast(step)
    tail = lambda name: F.slice(F.coalesce(v[name], empty), F.lit(2), F.greatest(F.lit(0), F.size(F.coalesce(v[name], empty)) - 1))
    hop = lambda label, sym: F.struct(label.alias("label"), sym.alias("sym"))
    up, down = tail("rule-to-boundary-path"), tail("boundary-to-constructor-path")
    parts = F.concat(
        F.array(hop(F.lit("rule"), rule)),
        F.transform(up, lambda x: hop(F.lit("caller"), x["var-name-sym"])),
        F.filter(F.array(hop(F.lit("boundary"), v["boundary-var-name-sym"])), lambda x: x["sym"].isNotNull()),
        F.transform(down, lambda x, i: hop(F.when(i == F.size(down) - 1, "constructor").otherwise("caller"), x["var-name-sym"])),
    )
    return F.when(v["boundary-in-var"].isNotNull(), parts)
