"""Read-side queries and list algebra: lookups, search, groups, stable keys, rebased names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..runtime import ranks


def lookup(rows: DataFrame, ident: str, value: str) -> DataFrame:
    return rows.filter(F.col(ident) == value)


def search(rows: DataFrame, text: str, query: str) -> DataFrame:
    return rows.filter(names.matches(F.col(text), query))


NO_GROUP = "(no namespace)"


def groups(rows: DataFrame, by: Column, name: str = "group") -> DataFrame:
    """Sizes of groups; rows without one, or with an empty one, are one group."""
    return rows.withColumn(name, F.coalesce(F.nullif(by, F.lit("")), F.lit(NO_GROUP))).groupBy(name).agg(F.count("*").alias("n"))


def group_index(rows: DataFrame, by: Column, order: str) -> DataFrame:
    """group, n and first (the place of its first row): groups are shown in the order in which they appear."""
    return rows.withColumn("group", F.coalesce(F.nullif(by, F.lit("")), F.lit(NO_GROUP))).groupBy("group").agg(F.count("*").alias("n"), F.min(order).alias("first"))


def type_group(name: Column, ns: Column) -> Column:
    """A fact type's group: its namespace, else that of its name without the colon, up to the last slash or dot."""
    return F.coalesce(ns, names.display_parts(F.regexp_replace(name, "^:", ""))["ns"])


#: Ids of the filters of a list of rules.
RULE_FILTERS = {
    "unresolved-dynamic-inserts": lambda: F.coalesce(F.col("insert_resolution") != "full", F.lit(False)),
    "unresolved-dynamic-retracts": lambda: F.coalesce(F.col("retract_resolution") != "full", F.lit(False)),
    "unlinked": lambda: F.coalesce(F.col("unlinked"), F.lit(False)),
    "source": lambda: F.coalesce(F.col("source"), F.lit(False)),
    "sink": lambda: F.coalesce(F.col("sink"), F.lit(False)),
}


def any_filter(active: list[str]) -> Column:
    """Rows that one of the active filters lets through; all, if none is active."""
    out = F.lit(not active)
    for k in active:
        out |= RULE_FILTERS[k]()
    return out


def view(rows: DataFrame, fields: list[str], group: Column, query: str = "", hidden: tuple[str, ...] = (), active: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a list that are shown, with their group. A search looks through all groups; without one, hidden groups
    are left out. Filters count in both."""
    out = rows.withColumn("group", F.coalesce(F.nullif(group, F.lit("")), F.lit(NO_GROUP))).filter(any_filter(list(active)))
    if query:
        hit = F.lit(False)
        for f in fields:
            hit |= names.matches(F.col(f), query)
        return out.filter(hit)
    return out.filter(~F.col("group").isin(*hidden)) if hidden else out


def filtered_out(item: Column, query: str, fields: list[str], group: Column, hidden: tuple[str, ...], active: tuple[str, ...]) -> Column:
    """Whether an item that is open is missing from its list, for its text, its group or the filters."""
    hit = F.lit(not query)
    for f in fields:
        hit |= names.matches(F.col(f), query) if query else F.lit(True)
    return item.isNotNull() & ~(hit & ~F.coalesce(group, F.lit(NO_GROUP)).isin(*(hidden or ("",))) & any_filter(list(active)))


def toggled(hidden: frozenset[str], group: str, every: list[str]) -> frozenset[str]:
    """Hidden groups after a click: the first shows that group alone, further ones show or hide theirs; none left shows all."""
    if not hidden:
        return frozenset(every) - {group}
    now = hidden ^ {group}
    return frozenset() if now >= frozenset(every) else now


def related(rows: DataFrame, side: str, type_id: str) -> DataFrame:
    """name and the references of one side (upstream or downstream) that meet it through a type: by what their consumer reads
    upstream, by what their producer makes downstream."""
    end = "consumer_type" if side == "upstream" else "producer_type"
    refs = F.filter(F.coalesce(F.col(side), F.array()), lambda r: F.exists(r["match"], lambda m: m[end]["id"] == type_id))
    return rows.select("name", refs.alias("refs")).filter(F.size("refs") > 0)


def categories(row: dict[str, int]) -> list[tuple[str, int]]:
    """Kinds of activity that there is any of, with their counts."""
    return [(k, n) for k, n in row.items() if n]


def stable_keys(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Second and later equal keys get a numbered suffix. Rows are dealt by ranges of key and order, a hot key over all tasks."""
    out = ranks(rows, [key], [F.col(o) for o in order], "__k")
    return out.withColumn("stable_key", F.when(F.col("__k") == 0, F.col(key)).otherwise(F.concat(F.col(key), F.lit("__dup-"), F.col("__k").cast("string")))).drop("__k")


def cleaned(values: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(values, lambda k, v: v.isNotNull())


def text_keys(values: Column) -> Column:
    """A map whose keys are printed without their colon."""
    return F.transform_keys(values, lambda k, v: F.regexp_replace(k.cast("string"), "^:", ""))


def unknown(rows: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return rows.join(known.select(on).distinct(), on, "left_anti")


def by_name(rows: DataFrame, name: str = "name") -> DataFrame:
    """rows in the order in which readers expect names; of names that are equal in it, and without one, by code point."""
    return rows.orderBy(names.collated(F.col(name)).asc_nulls_last(), name)
