"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang a node's larger (or smaller) neighbours on its smallest one. Minima are combined before the shuffle."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node and label (the smallest node of its component) of every node of edges(a, b).

    No node's neighbours are ever collected. Self-loops and repeated edges are fine; an empty table gives an empty one."""

    def written(rows: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges as a table, with their number and two sums over all of them."""
        table = cut(rows, "edges")
        sums = [F.sum(h("a", "b").cast("decimal(38,0)")) for h in (F.xxhash64, F.hash)]
        return table, tuple(table.agg(F.count("*"), *sums).first())

    now, state = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        if not state[0]:
            break
        before = state
        now, state = written(_star(_star(now, True), False))
        if state == before:
            break
    else:
        raise RuntimeError(f"components change after {most_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
