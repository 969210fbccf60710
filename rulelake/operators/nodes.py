"""The compiled network: its nodes, their parents, and which productions and queries each leads to.

nodes(id, kind, children array<string>, name, detail): name is a terminal's production."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import callgraph, graph

#: Kinds of nodes.
KINDS = ("alpha", "root-join", "hash-join", "expression-join", "negation", "test", "accumulate", "production", "query")
TERMINAL = ("production", "query")


def terminals(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*TERMINAL)).select("id", "kind", "name")


def leads_to(nodes: DataFrame, most_edges: int = graph.MOST_EDGES) -> DataFrame:
    """id, productions, queries: sorted names of the terminals that each node reaches downward, its own included."""
    up = nodes.select(F.explode("children").alias("child"), F.col("id").alias("parent"))
    ends = terminals(nodes)
    reached = graph.reach(up, ends.select("id"), most_edges).join(ends.withColumnRenamed("id", "start"), "start").select(F.col("node").alias("id"), "kind", "name")
    every = reached.unionByName(ends.select("id", "kind", "name")).distinct()
    pick = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))
    return every.groupBy("id").agg(pick("production").alias("productions"), pick("query").alias("queries"))


def summaries(nodes: DataFrame, most_edges: int = graph.MOST_EDGES) -> DataFrame:
    """Every node with its parents and what it leads to; a kind that isn't known keeps its columns."""
    none = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    both = nodes.join(leads_to(nodes, most_edges), "id", "left").join(callgraph.parents(nodes), "id", "left")
    return both.select(*[c for c in nodes.columns if c != "children"], none("children"), none("productions"), none("queries"), none("parents"))
