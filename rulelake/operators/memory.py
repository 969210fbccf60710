"""Working memory: fact ids, and who inserted, matched and bound which fact. Facts are told apart by uid, not by value.

facts(uid, type, ns, data, root), activations(activation, prod, bindings), matches(activation, uid, accumulated array),
insertions(seq, prod, uid); data and bindings are JSON. productions(name, prod_ord, ns, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..runtime import ranks
from . import depgraph

#: The group of facts that no rule inserted, the type of facts without one, and the place of what has none.
ROOT = "Root Facts (External)"
UNKNOWN_TYPE = ":unknown/fact-type"
LAST = 2**31 - 1


def canonical(data: Column) -> Column:
    """JSON with the keys of all objects in order and numbers in their shortest form, so that equal values have equal texts; texts
    that aren't JSON, or repeat a key in an object, stay."""
    return F.coalesce(F.to_json(F.try_parse_json(data)), data)


def type_order(read: DataFrame) -> DataFrame:
    """type and its first place on the left side of any production, in load order. read(prod_ord, pos, type)."""
    first = read.groupBy("type").agg(F.min(F.struct("prod_ord", "pos")).alias("at"))
    return ranks(first, [], [F.col("at"), F.col("type")], "type_order").select("type", "type_order")


def fact_ids(facts: DataFrame, per_type: DataFrame) -> DataFrame:
    """fact_id 1..n by (type order, type, canonical text, uid). facts(uid, type, canon); per_type(type, type_order).

    Types without an order come last; a null type is UNKNOWN_TYPE. Facts are dealt by ranges of that order, so that no
    task sorts all facts of a type."""
    rows = facts.withColumn("type", F.coalesce("type", F.lit(UNKNOWN_TYPE))).join(per_type, "type", "left").withColumn("type_order", F.coalesce("type_order", F.lit(LAST)))
    numbered = ranks(rows, [], [F.col("type_order"), F.col("type"), F.col("canon"), F.col("uid")], "rank")
    return numbered.select("uid", "type", (F.col("rank") + 1).cast("long").alias("fact_id"))


def matched(matches: DataFrame) -> DataFrame:
    """activation and uid of each distinct matched fact: what an accumulator gathered, else the fact itself."""
    own = F.when(F.size(F.coalesce("accumulated", F.array().cast("array<bigint>"))) > 0, F.col("accumulated")).otherwise(F.array("uid"))
    return matches.select("activation", F.explode(own).alias("uid")).filter("uid is not null").distinct()


def gathered(rows: DataFrame, fact: str, prod: str, name: str, order: DataFrame | None = None) -> DataFrame:
    """Distinct productions of each fact: used-by from matches, origins from insertions. In load order, if order(name,
    prod_ord) is given, those without one last; else by name."""
    d = rows.filter(F.col(fact).isNotNull()).select(fact, prod).distinct()
    if order is None:
        return d.groupBy(fact).agg(F.array_sort(F.collect_list(prod)).alias(name))
    d = d.join(order.select(F.col("name").alias(prod), "prod_ord"), prod, "left")
    return d.groupBy(fact).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("prod_ord", F.lit(LAST)).alias("o"), F.col(prod).alias("p")))), lambda x: x["p"]).alias(name))


def role_groups(facts: DataFrame, roles: DataFrame, uid: str = "uid") -> DataFrame:
    """type, role, n: facts of a type by production; those without one are root facts. roles(uid, prod)."""
    rows = facts.select(uid, "type").join(roles.select(uid, "prod").distinct(), uid, "left").withColumn("role", F.coalesce("prod", F.lit(ROOT)))
    return rows.groupBy("type", "role").agg(F.count("*").alias("n"))


def match_bindings(matches: DataFrame) -> DataFrame:
    """prod, uid, n_bindings and bindings: distinct binding texts of each matched fact, sorted. matches(prod, uid, binding)."""
    return matches.groupBy("prod", "uid").agg(F.array_sort(F.collect_set("binding")).alias("bindings")).withColumn("n_bindings", F.size("bindings").cast("long"))


class Memory:
    """The relations of a session's working memory, each a plan of its own; nothing is computed before it is asked for.

    known(type): the types that the rulebase uses. A smaller or larger one is stamped by `restamped` without another look at
    the facts."""

    def __init__(self, facts: DataFrame, activations: DataFrame, matches: DataFrame, insertions: DataFrame, productions: DataFrame, per_type: DataFrame, known: DataFrame | None = None, ids: DataFrame | None = None):
        self.activations, self.insertions, self.productions, self.per_type = activations, insertions, productions, per_type
        self.known = known.select("type").distinct() if known is not None else None
        self._parts = (facts, activations, matches, insertions, productions, per_type)
        self.raw = facts.withColumns({"type": F.coalesce("type", F.lit(UNKNOWN_TYPE)), "canon": canonical(F.col("data"))})
        self.ids = ids if ids is not None else fact_ids(self.raw.select("uid", "type", "canon"), per_type)
        self.pairs = matched(matches).join(activations, "activation")

    def restamped(self, known: DataFrame) -> Memory:
        return Memory(*self._parts, known=known, ids=self.ids)

    def _flagged(self, rows: DataFrame) -> DataFrame:
        if self.known is None:
            return rows.withColumn("known", F.lit(True))
        return rows.join(self.known.withColumn("known", F.lit(True)), "type", "left").withColumn("known", F.coalesce("known", F.lit(False)))

    def roles(self, rows: DataFrame, name: str) -> DataFrame:
        """uid and references of its distinct productions, in load order; productions that aren't known keep their name."""
        refs = depgraph.production_refs(self.productions).join(self.productions.select("name", "prod_ord"), "name")
        d = rows.select("uid", F.col("prod").alias("name")).filter("uid is not null and name is not null").distinct().join(refs, "name", "left")
        bare = F.struct("name", names.route_id(F.col("name")).alias("id"), F.coalesce(names.namespace(F.col("name")), F.lit("")).alias("ns"), F.lit("rule").alias("type"))
        row = F.struct(F.coalesce("prod_ord", F.lit(LAST)).alias("o"), F.coalesce("ref", bare).alias("ref"))
        return d.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["ref"]).alias(name))

    def facts(self) -> DataFrame:
        """id, uid, type {name, id, known}, ns, data, is_root, inserted_from, used_by of every fact."""
        empty = lambda c: F.coalesce(c, F.array().cast("array<struct<name:string,id:string,ns:string,type:string>>")).alias(c)
        rows = self.raw.drop("type").join(self.ids, "uid").join(self.roles(self.insertions, "inserted_from"), "uid", "left").join(self.roles(self.pairs, "used_by"), "uid", "left")
        rows = self._flagged(rows)
        return rows.select(F.col("fact_id").alias("id"), "uid", names.type_ref(F.col("type"), F.col("known")).alias("type"), "ns", "data", F.coalesce("root", F.lit(False)).alias("is_root"), empty("inserted_from"), empty("used_by"))

    def types(self) -> DataFrame:
        """name, id, ns and count of each type's facts."""
        rows = self.raw.groupBy(F.col("type").alias("name")).agg(F.min_by("ns", "uid").alias("ns"), F.count("*").alias("count"))
        return rows.withColumn("id", names.route_id(F.col("name")))

    def groups(self, role: str = "inserted_from") -> DataFrame:
        """type, place, name, id, ns, kind and fact ids (an array per group: one group's facts are one answer) by origin or use;
        facts without an origin form the root group, which comes first."""
        f = self.facts().select(F.col("type.name").alias("type"), "id", F.explode_outer(role).alias("r") if role == "inserted_from" else F.explode(role).alias("r"))
        ord_of = self.productions.select("name", "prod_ord")
        f = f.select("type", "id", F.coalesce("r.name", F.lit(ROOT)).alias("name"), F.coalesce("r.type", F.lit("root")).alias("kind"), F.when(F.col("r").isNotNull(), F.col("r.ns")).alias("ns"))
        g = f.groupBy("type", "name", "kind", "ns").agg(F.array_sort(F.collect_list("id")).alias("facts")).join(ord_of, "name", "left")
        return g.select("type", F.when(F.col("kind") == "root", -1).otherwise(F.coalesce("prod_ord", F.lit(LAST))).alias("place"), "name", names.route_id(F.col("name")).alias("id"), "ns", "kind", "facts")

    def activity(self) -> DataFrame:
        """prod, fact_id, bindings: each fact that a production matched, once, with its distinct bindings in canonical order."""
        rows = self.pairs.select("prod", "uid", canonical(F.col("bindings")).alias("binding"))
        return match_bindings(rows).join(self.ids.select("uid", "fact_id"), "uid").select("prod", "fact_id", "bindings")

    def inserted(self) -> DataFrame:
        """prod, fact_id, place: distinct facts that a rule inserted, in the order of their first insertion."""
        rows = self.insertions.join(self.ids.select("uid", "fact_id"), "uid")
        return rows.groupBy("prod", "fact_id").agg(F.min("seq").alias("place"))


def node_elements(elements: DataFrame, ids: DataFrame) -> DataFrame:
    """node, fact_id, n and bindings: the facts that a node holds, once for each different binding, and how often. Facts without
    an id are left out; bindings that are equal as values are one.

    elements(node, uid, bindings); ids(uid, fact_id). No node's facts are ever gathered."""
    rows = elements.join(ids.select("uid", "fact_id"), "uid").withColumn("bindings", canonical(F.col("bindings")))
    return rows.groupBy("node", "fact_id", "bindings").agg(F.count("*").alias("n"))


def node_tokens(tokens: DataFrame, ids: DataFrame) -> DataFrame:
    """node, token, fact_ids (in the order of their conditions; null for one without an id) and bindings of each partial match
    that a node holds.

    tokens(node, token, pos, uid, bindings): a row for each fact of a token, or one without a fact. A token has as many facts
    as its production has conditions."""
    rows = tokens.join(ids.select("uid", "fact_id"), "uid", "left")
    facts = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "fact_id")))), lambda x: x["fact_id"])
    return rows.groupBy("node", "token").agg(facts.alias("fact_ids"), canonical(F.min("bindings")).alias("bindings"))
