"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets that fit in memory, by a seeded hash. Pass two shuffles each bucket
by Fisher and Yates and writes it. The place of a record in the whole order is its bucket's offset plus its place there;
equal ranges of places are the shards, so their counts are at most one apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, free

OVERHEAD = 16


def record_size(text: Column) -> Column:
    """Bytes of the text in UTF-8 and of its record's header."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation: position i from the last to the second swaps with one that isn't after it."""
    p = np.arange(n)
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist(), strict=True):
        p[i], p[j] = p[j], p[i]
    return p


def shard(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, and shard, slot (gapless from 0 in each shard) and position (in the whole order).

    The bucket of a record depends on the seed, its id and its text, so a lost task is made again with the same rows.
    Null texts and ids are records like any other; rows equal in id and text share a bucket. With fewer rows than
    shards, some shards stay empty. Columns of docs named shard, slot or position are replaced, all others stay.
    """
    docs = docs.drop("shard", "slot", "position")
    names, schema = docs.columns, docs.schema
    bucket = free("bucket", [*names, "shard", "slot", "position"])
    total = docs.agg(F.sum(record_size(col(text_col)))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes)) * 2
    place = F.pmod(F.xxhash64(F.lit(seed), col(id_col), F.crc32(F.encode(col(text_col), "UTF-8"))), F.lit(buckets)).alias(bucket)
    counts = docs.select(place.alias("__bucket")).groupBy("__bucket").agg(F.count("*").alias("__n"))
    # the running sum over buckets, in two steps that no single task sees whole
    counts = counts.withColumn("__block", F.floor(F.col("__bucket") / 1000).cast("long"))
    blocks = counts.groupBy("__block").agg(F.sum("__n").alias("__bn"))
    blocks = blocks.withColumn("__start", F.coalesce(F.sum("__bn").over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("__total", F.sum("__bn").over(W.partitionBy()))
    inner = F.coalesce(F.sum("__n").over(W.partitionBy("__block").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("__in", inner).join(blocks, "__block").select("__bucket", (F.col("__start") + F.col("__in")).cast("long").alias("__offset"), F.col("__total").cast("long").alias("__total"))

    def second(key: tuple, rows: pa.Table, offset: pa.Table) -> pa.Table:
        rows = rows.select(range(len(names)))
        n = rows.num_rows
        # a fixed start: rows in the order of id and text, however the first pass delivered them
        ids, crc = rows.column(names.index(id_col)), rows.column(names.index(text_col))
        start = np.lexsort([np.array([hash_text(x) for x in crc.to_pylist()], dtype=np.uint64), np.array([hash_text(str(x)) for x in ids.to_pylist()], dtype=np.uint64)])
        order = start[fisher_yates(n, np.random.default_rng([seed, key[0].as_py() or 0]))]
        first, whole = offset.column("__offset")[0].as_py(), offset.column("__total")[0].as_py()
        at = np.arange(first, first + n, dtype=np.int64)
        # shard s holds the places from ceil(s * whole / shards)
        which = at * shards // whole
        begins = -(-which * whole // shards)
        out = rows.take(pa.array(order))
        for name, values in (("shard", pa.array(which.astype(np.int32))), ("slot", pa.array(at - begins)), ("position", pa.array(at))):
            out = out.append_column(name, values)
        return out

    result = T.StructType([*schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("position", T.LongType())])
    return docs.withColumn(bucket, place).groupBy(bucket).cogroup(offsets.groupBy("__bucket")).applyInArrow(second, result)


def hash_text(text: str | None) -> int:
    import zlib

    return 0 if text is None else zlib.crc32(text.encode("utf-8", "surrogatepass")) + 1


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder of Parquet files per shard, rows in the order of their slots within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
