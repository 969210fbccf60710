"""Facts by type, with the fields of their data as columns, joins on bindings and queries with parameters. What a rule makes of
these is a plan of the caller's; nothing here runs rules.

facts(type, data): data is JSON, and a fact is known by both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTS = "type string, data string"


def typed(facts: DataFrame, ancestors: DataFrame | None, schemas: dict[str, str]) -> Callable[[str], DataFrame]:
    """Facts of a type and of its descendants, with the fields of its schema as columns, and the whole fact as `fact`."""

    def of(name: str) -> DataFrame:
        some = facts.filter(F.col("type") == name)
        if ancestors is not None:
            below = ancestors.filter(F.col("ancestor") == name).select("type")
            some = some.unionByName(facts.join(below, "type", "left_semi"))
        return some.select(F.struct("type", "data").alias("fact"), F.from_json("data", schemas[name]).alias("f")).select("fact", "f.*")

    return of


def made(rows: DataFrame, name: str, **columns: Column | str) -> DataFrame:
    """Facts of a type from rows: each named field is a column or an expression."""
    values = [(F.expr(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()]
    return rows.select(F.lit(name).alias("type"), F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("data"))


def once(facts: DataFrame) -> DataFrame:
    """What a rule without conditions matches: one row."""
    return facts.sparkSession.range(1).select(F.lit(1).alias("one"))


def bound(left: DataFrame, right: DataFrame, **bindings: str) -> DataFrame:
    """A join on bindings: left's column -> right's column. The first use of a name binds it, a later one compares."""
    on = [left[a] == right[b] for a, b in bindings.items()]
    both = left.join(right, on)
    for b in bindings.values():
        both = both.drop(right[b])
    return both


def query(facts: Callable[[str], DataFrame], name: str, **params) -> DataFrame:
    """Facts of a type whose fields equal the parameters, a null one included."""
    out = facts(name)
    for k, v in params.items():
        out = out.filter(F.col(k).eqNullSafe(F.lit(v)))
    return out
