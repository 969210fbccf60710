"""Answers found by id in a written index: one folder is read, whatever the size."""

from pyspark.sql import functions as F

from rulelake.operators import lookup


def test_one_folder_is_read(spark):
    rows = spark.range(5000).select(F.col("id").alias("n"), F.concat(F.lit("k"), (F.col("id") / 2).cast("long").cast("string")).alias("id"), F.lit("x.y").alias("a.b"))
    for per in (100, 1000, 10_000):
        index = lookup.written(rows, "id", per)
        found = index.get("k77")
        assert sorted(r.n for r in found.collect()) == [154, 155] and found.columns == rows.columns
        assert index.buckets == max(1, 5000 // per) and len(set(found.select(F.input_file_name()).collect())) == 1
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert f"PartitionFilters: [isnotnull(__bucket" in plan and "EqualTo(id,k77)" in plan
    assert index.get("none").collect() == [] and index.get(None).collect() == []


def test_hot_ids_null_ids_and_empty_tables(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 2 == 0, F.col("id")).cast("long").alias("id"), F.col("id").alias("n"))
    index = lookup.written(rows, "id", 50)
    assert index.get(7).count() == 2000 and index.get(6).count() == 1 and index.get(9).count() == 0
    assert lookup.written(rows.limit(0), "id").get(1).collect() == []
