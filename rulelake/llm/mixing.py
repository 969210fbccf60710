"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its integral gives the source's share of all words; the
running integral is its cumulative demand. A document occupies an interval of its source's supply (epoch after epoch, in
a seeded order), and inverting the demand at that interval's start gives its training position. Placements are then
range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, cut, n_words, partitions, ranked

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: Shapes in time, (time, height) knots with a mean of 1: heavy sources fade, light ones come late.
SHAPES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
MOST = 3


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, weight, source_size and target of each source of sized(source, size).

    The excess over `most` times a source's size is shared again by weight until none is above: with the sources in order
    of most * size / weight, those capped are a prefix. All sums are integers, so that the targets are reproducible."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    by = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    per = per.withColumns({"all_size": F.sum("source_size").over(everything), "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    # capped if what is left, shared by weight, would give it more than its cap
    left = F.col("all_size") - F.col("cap_before")
    per = per.withColumn("capped", F.col("cap") * F.col("weight_left") < left * F.col("weight"))
    per = per.withColumns({"cap_sum": F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything), "free_weight": F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(everything)})
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(((F.col("all_size") - F.col("cap_sum")) * F.col("weight")).cast("double") / F.col("free_weight"))
    return per.withColumn("target", F.coalesce(target, F.lit(0.0))).select("source", "weight", "source_size", "target")


def _shape(weight: Column, weights: tuple[int, ...], shapes: tuple) -> Column:
    """The knots of a source's schedule, each with the integral up to it, of a total of 1."""
    out = F.lit(None)
    for w in dict.fromkeys(weights):
        knots, area, rows = shapes[weights.index(w) % len(shapes)], 0.0, []
        for i, (t, h) in enumerate(knots):
            if i:
                area += (t - knots[i - 1][0]) * (h + knots[i - 1][1]) / 2
            rows.append((t, h, area))
        out = F.when(weight == w, F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(h) / area).alias("h"), F.lit(a / area).alias("a")) for t, h, a in rows])).otherwise(out)
    return out


def _invert(knots: Column, demand: Column) -> Column:
    """The time at which the running integral of a piecewise linear schedule reaches the demand, 0 to 1."""
    last = F.greatest(F.lit(1), F.least(F.size(knots) - 1, F.size(F.filter(knots, lambda k: k["a"] <= demand))))
    k0, k1 = F.element_at(knots, last), F.element_at(knots, last + 1)
    span, rest = k1["t"] - k0["t"], F.greatest(F.lit(0.0), demand - k0["a"])
    slope = (k1["h"] - k0["h"]) / span
    root = F.sqrt(F.greatest(F.lit(0.0), k0["h"] * k0["h"] + 2 * slope * rest))
    return F.least(F.lit(1.0), k0["t"] + F.when(k0["h"] + root > 0, 2 * rest / (k0["h"] + root)).otherwise(0.0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, shapes: tuple = SHAPES, most: int = MOST, whole: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and placements (epoch, words, position) for every row of docs.

    Rows without words get no placement; a source without words has a target of 0 and takes nothing. With whole, documents aren't cut: one is placed again where at least half of it
    falls within the source's target. Without, the last document of a source gives the words that are still missing, and
    the sum of a source's words is its target rounded. Null sources form one source; null texts have no words. An empty
    table gives an empty result; rows that repeat an id are placed each for itself.
    """
    sized = cut(docs.select(col(id_col).alias("doc_id"), col(source_col).alias("source"), n_words(col(text_col)).alias("size")), "sizes")
    targets = source_targets(sized, weights, most)
    placed = ranked(sized, ["source"], [F.col("doc_id"), F.col("size")], "before", weight=F.col("size"))
    both = placed.join(targets.withColumnRenamed("source", "__s"), placed["source"].eqNullSafe(F.col("__s"))).drop("__s")
    goal, per = F.round("target").cast("long"), F.col("source_size")
    both = both.withColumn("__epochs", F.when(per > 0, F.floor(goal / per)).otherwise(0).cast("int")).withColumn("__rest", goal - F.col("__epochs") * per - F.col("before"))
    part = F.when(F.col("__rest") * 2 >= F.col("size"), F.col("size")).otherwise(0) if whole else F.greatest(F.lit(0), F.least(F.col("__rest"), F.col("size")))
    both = both.withColumns({"__part": F.when(F.col("__epochs") < most, part).otherwise(0).cast("long"), "__knots": _shape(F.col("weight"), weights, shapes)})
    at = lambda e: _invert(F.col("__knots"), F.least(F.lit(1.0), F.coalesce(F.try_divide(e * per + F.col("before"), F.col("target")), F.lit(1.0))))
    runs = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda e: F.struct(e.alias("epoch"), F.when(e < F.col("__epochs"), F.col("size")).when(e == F.col("__epochs"), F.col("__part")).otherwise(0).alias("words"), at(e).alias("position")))
    both = both.withColumn("placements", F.filter(runs, lambda r: r["words"] > 0))
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda a, r: a + r["words"])
    return both.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "placements")


def schedule(mixed: DataFrame, n: int | None = None) -> DataFrame:
    """One row per placement in training order: range-partitioned and sorted by position."""
    rows = mixed.select("doc_id", "source", "size", "source_size", "target", F.explode_outer("placements").alias("p")).select("*", "p.*").drop("p")
    return rows.repartitionByRange(n or partitions(mixed.sparkSession), F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id", "epoch")
