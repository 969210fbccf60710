"""Call graphs: who calls whom, what is reachable up to the boundary, and by which shortest path. calls(caller, callee)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

#: Functions that insert facts, and those that retract them. Walks end there.
INSERTS = (
    "clara.rules/insert!",
    "clara.rules/insert-unconditional!",
    "clara.rules/insert-all-unconditional!",
    "clara.rules/insert-all!",
    "clara.rules.engine/insert-facts!",
    "clara.rules/insert",
    "clara.rules/insert-unconditional",
    "clara.rules/insert-all",
)
RETRACTS = ("clara.rules/retract!", "clara.rules.engine/rhs-retract-facts!", "clara.rules/retract")
BOUNDARY = INSERTS + RETRACTS


def qualified(ns: Column, name: Column) -> Column:
    """ns/name; null without a name, the bare name without a namespace."""
    return F.when(ns.isNull(), name).otherwise(F.concat(ns, F.lit("/"), name))


def calls(usages: DataFrame) -> DataFrame:
    """Distinct (caller, callee) of usages(from, from_var, to, name) that are written inside a definition."""
    return usages.filter("from_var is not null").select(qualified(F.col("from"), F.col("from_var")).alias("caller"), qualified(F.col("to"), F.col("name")).alias("callee")).distinct()


def inner(calls: DataFrame, boundary: tuple[str, ...] = BOUNDARY) -> DataFrame:
    """The calls that are walked on from: those of boundary functions aren't."""
    return calls.filter(~F.col("caller").isin(*boundary)) if boundary else calls


def reachable(calls: DataFrame, starts: DataFrame | None = None, boundary: tuple[str, ...] = (), itself: bool = False, most_edges: int = graph.MOST_EDGES) -> DataFrame:
    """(caller, callee) of all that is reachable from each start (from every caller, if none is given).

    Boundary functions are reached but not walked on from. With `itself`, a start reaches itself; else only on a cycle."""
    e = inner(calls, boundary).select("caller", "callee")
    s = e.select("caller").distinct() if starts is None else starts.select(F.col(starts.columns[0]).alias("caller"))
    out = graph.reach(e, s, most_edges).toDF("caller", "callee")
    return out.unionByName(s.filter("caller is not null").select("caller", F.col("caller").alias("callee"))).distinct() if itself else out


def direct_callers(calls: DataFrame, targets: tuple[str, ...] | None = None) -> DataFrame:
    """callee and its sorted callers, of all or of the target functions."""
    some = calls if targets is None else calls.filter(F.col("callee").isin(*targets))
    return some.select("callee", "caller").distinct().groupBy("callee").agg(F.array_sort(F.collect_list("caller")).alias("callers"))


def inserters(calls: DataFrame, targets: tuple[str, ...] = INSERTS) -> DataFrame:
    """var: whoever calls a target itself and isn't one."""
    return calls.filter(F.col("callee").isin(*targets) & ~F.col("caller").isin(*targets)).select(F.col("caller").alias("var")).distinct()


def var_reachability(calls: DataFrame, starts: DataFrame, most_edges: int = graph.MOST_EDGES) -> DataFrame:
    """start, reachable (sorted, with itself), inserts and retracts: whether an insertion or retraction is reached."""
    near = reachable(calls, starts, BOUNDARY, itself=True, most_edges=most_edges)
    ins, rets = F.bool_or(F.col("callee").isin(*INSERTS)), F.bool_or(F.col("callee").isin(*RETRACTS))
    return near.groupBy(F.col("caller").alias("start")).agg(F.array_sort(F.collect_set("callee")).alias("reachable"), ins.alias("inserts"), rets.alias("retracts"))


def shortest_paths(calls: DataFrame, starts: DataFrame, most_edges: int = graph.MOST_EDGES) -> DataFrame:
    """start, node, path: breadth first; of paths of equal length, the one whose names come first."""
    return graph.shortest(calls.select("caller", "callee"), starts.select("start"), most_edges)


def boundary_paths(paths: DataFrame) -> DataFrame:
    """start, node and path of shortest_paths without those from a node to itself, which say nothing."""
    return paths.filter("start <> node")


def parents(nodes: DataFrame) -> DataFrame:
    """id -> parents of nodes(id, children array); roots have an empty array."""
    up = nodes.select(F.col("id").alias("parent"), F.explode("children").alias("id")).groupBy("id").agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    both = nodes.select("id").distinct().join(up, "id", "full")
    return both.select("id", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))


def earliest_usages(subtrees: DataFrame, usages: DataFrame, types: DataFrame) -> DataFrame:
    """inserter, type and its first constructor usage (by filename, row, col) in each inserter's subtree.

    subtrees(inserter, node); usages(caller, to, name, filename, row, col); types(ns, name, type): what a constructor's
    name stands for in a namespace. ->X and map->X build X."""
    made = usages.filter(F.col("name").startswith("->") | F.col("name").startswith("map->")).withColumn("built", F.regexp_replace("name", "^(map)?->", ""))
    typed = made.join(types.select(F.col("ns").alias("to"), F.col("name").alias("built"), "type"), ["to", "built"])
    at = F.struct(F.coalesce("filename", F.lit("")).alias("f"), F.coalesce("row", F.lit(0)).alias("r"), F.coalesce("col", F.lit(0)).alias("c"))
    rows = subtrees.join(typed, F.col("node") == F.col("caller"))
    return rows.groupBy("inserter", "type").agg(F.min_by(F.struct("caller", "to", "name", "filename", "row", "col"), at).alias("usage"))


def spec_usages(subtrees: DataFrame, usages: DataFrame, specs: DataFrame) -> DataFrame:
    """inserter, the usage's columns and spec: usages in a subtree whose callee a declared constructor spec names; of
    several specs, the first one. specs(pattern, spec): a regular expression over the whole callee, and its place."""
    named = usages.withColumn("callee", qualified(F.col("to"), F.col("name")))
    names = named.select("callee").distinct()
    first = names.join(F.broadcast(specs), F.expr("callee rlike concat('^(?:', pattern, ')$')")).groupBy("callee").agg(F.min("spec").alias("spec"))  # few specs, given by the caller
    return subtrees.join(named.join(first, "callee"), F.col("node") == F.col("caller")).drop("node")


def alias_pairs(bindings: DataFrame, own_usages: DataFrame, specs: DataFrame) -> DataFrame:
    """Distinct (rule, type, var): a rule's bound fact is a function of its own, if its type's spec names the variable it
    aliases and the rule's body uses the binding.

    bindings(rule, binding, type); own_usages(rule, name): names used in the rule's body; specs(type, var), of which only
    qualified variables count."""
    named = specs.filter(F.instr("var", "/") > 0)
    used = own_usages.select("rule", F.col("name").alias("binding")).distinct()
    return bindings.join(used, ["rule", "binding"], "left_semi").join(named, "type").select("rule", "type", "var").distinct()


def alias_usages(pairs: DataFrame) -> DataFrame:
    """A usage without a place for each pair: the rule calls the aliased variable."""
    at, cut_ns = F.instr("rule", "/"), lambda c: F.substring_index(c, "/", 1)
    local = F.expr("substring(rule, instr(rule, '/') + 1)")
    none = lambda t: F.lit(None).cast(t)
    return pairs.select(F.when(at > 0, cut_ns("rule")).alias("from"), local.alias("from_var"), cut_ns("var").alias("to"), F.expr("substring(var, instr(var, '/') + 1)").alias("name"), none("string").alias("filename"), none("int").alias("row"), none("int").alias("col"), none("int").alias("end_row"), none("int").alias("end_col"))


def alias_contexts(pairs: DataFrame, subtrees: DataFrame) -> DataFrame:
    """rule, caller, type and var: by which alias a caller is reached; of several, the first by the type's name.

    subtrees(inserter, node) from each aliased variable, itself included."""
    rows = pairs.join(subtrees, F.col("var") == F.col("inserter"))
    return rows.groupBy("rule", F.col("node").alias("caller")).agg(F.min_by(F.struct("type", "var"), F.struct("type", "var")).alias("v")).select("rule", "caller", "v.*")
