"""Rule conditions as joins: and, not, exists, or, test and accumulators over fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def both(left: DataFrame, right: DataFrame, on: list[str], test: Column | None = None) -> DataFrame:
    """A hash join on shared bindings; a test over both sides filters it."""
    out = left.join(right, on)
    return out if test is None else out.filter(test)


def absent(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def exists(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_semi")


def either(*branches: DataFrame) -> DataFrame:
    """A rule with alternatives is as many rules: rows of each branch stay."""
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out


def accumulate(facts: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    """Counts, sums, extremes and distinct values per binding."""
    return facts.groupBy(*by).agg(*[a.alias(k) for k, a in aggregates.items()])


def accumulate_outer(left: DataFrame, facts: DataFrame, on: list[str], empty: dict[str, object], **aggregates: Column) -> DataFrame:
    """Accumulators with an initial value also fire for bindings without facts."""
    return left.join(accumulate(facts, on, **aggregates), on, "left").fillna(empty)
