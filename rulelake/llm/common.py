"""What the corpus operators share: word and white-space classes, folds, and tables that cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, shared_dir, sized

__all__ = ["SPACE", "SPACE_CHARS", "WORD", "col", "cut", "fold", "free", "freeing", "mix64", "n_words", "partitions", "powers", "ranked", "shared_dir", "sized", "words"]

#: ASCII white space; everything else belongs to words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def words(text: Column) -> Column:
    """Array of words; empty for a null or blank text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(name: str, columns: list[str]) -> str:
    """name, with as many underscores after it as it takes to be no column's (names differ by more than their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Return freed memory to the system. The C library keeps up to 64 MB of it, and Python workers live on through later stages."""
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def freeing(f: Callable) -> Callable:
    """f, a generator over a task's batches or a function of a group's key and table, that gives freed memory back at its end."""
    if inspect.isgeneratorfunction(f):

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from f(batches)
            finally:
                give_back()

        return rows

    def group(key: tuple, t: pa.Table) -> pa.Table:
        try:
            return f(key, t)
        finally:
            give_back()

    return group


def mix64(x: np.ndarray) -> np.ndarray:
    """A mixing of 64-bit numbers that loses nothing."""
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(m)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, or more, of a fixed odd number and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def ranked(df: DataFrame, group: list[str], order: list[Column], rank: str, rows_per_bucket: int = 4096, weight: Column | None = None, total: str | None = None) -> DataFrame:
    """Add `rank`: the sum of `weight` (default 1) over the rows of the group that come before this one.

    Like a window by group ordered by a seeded hash of `order`, but no task gets more than about rows_per_bucket rows:
    groups are cut into buckets by the hash, bucket sums are accumulated per group, and only rows of a bucket are sorted.
    `total`, if named, gets the group's sum. Rows that are equal in `order` may swap places."""
    from pyspark.sql import Window as W

    w = (F.lit(1) if weight is None else weight).cast("long")
    base = df.withColumns({"__w": w, "__h": F.shiftrightunsigned(F.xxhash64(F.lit(7919), *order), 1)})
    keys = [F.coalesce(F.to_json(F.struct(*[col(g) for g in group])), F.lit("{}")) if group else F.lit("{}")]
    base = base.withColumn("__g", keys[0])
    sizes = base.groupBy("__g").agg(F.count("*").alias("__n"), F.sum("__w").alias("__t"))
    sizes = sizes.withColumn("__nb", F.greatest(F.lit(1), F.ceil(F.col("__n") / rows_per_bucket)).cast("long")).select("__g", "__nb", "__t")
    base = base.join(sizes, "__g").withColumn("__b", F.expr("cast(__h / (9223372036854775807 / __nb) as long)"))
    base = base.repartition(F.col("__g"), F.col("__b"))  # else the join's partitioning by group would do for what follows, and a hot group would stay whole
    sums = base.groupBy("__g", "__b").agg(F.sum("__w").alias("__s"))
    sums = sums.withColumn("__base", F.coalesce(F.sum("__s").over(W.partitionBy("__g").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    base = base.join(sums, ["__g", "__b"])
    within = F.coalesce(F.sum("__w").over(W.partitionBy("__g", "__b").orderBy("__h", *order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = base.withColumn(rank, F.col("__base") + within)
    if total:
        out = out.withColumn(total, F.col("__t"))
    return out.drop("__w", "__h", "__g", "__nb", "__t", "__b", "__base")
