"""Answers written once and found by id: hashed into folders, sorted within them, with Bloom filters on the id.

A lookup reads one folder, which the plan tells before any file is opened, and of its files only the row groups that may hold
the id. What it costs doesn't depend on how many answers there are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import fresh_path

BUCKET = "__bucket"


@dataclass(frozen=True, eq=False)
class Index:
    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    buckets: int

    def get(self, value) -> DataFrame:
        """The rows with this id; none for one that isn't there, or null."""
        wanted = F.lit(value).cast(self.schema[self.key].dataType)
        rows = self.spark.read.schema(T.StructType([*self.schema, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)
        return rows.filter((F.col(BUCKET) == bucket_of(wanted, self.buckets)) & (F.col(self.key) == wanted)).drop(BUCKET)


    def all(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path).drop(BUCKET)


def bucket_of(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def written(rows: DataFrame, key: str, rows_per_bucket: int = 100_000) -> Index:
    """An index of rows by key, as large as it takes for about rows_per_bucket rows in a folder; rows without a key are left out.

    An id with very many rows is one folder of several files: its rows are dealt by size, not to one task. rows are read twice,
    to be counted and to be written: give a table. An empty one gives an index without rows."""
    spark = rows.sparkSession
    some = rows.filter(F.col(key).isNotNull())
    buckets = max(1, -(-some.count() // rows_per_bucket))
    path = fresh_path(spark, "index")
    dealt = some.withColumn(BUCKET, bucket_of(F.col(key), buckets)).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, key)
    dealt.write.partitionBy(BUCKET).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
    return Index(spark, path, T.StructType(rows.schema.fields), key, buckets)
