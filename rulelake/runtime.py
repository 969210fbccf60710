"""Session helpers: a tuned local session, shipping this package to Python workers, tables that cut lineage, exact ranks."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster's own settings win where a session exists."""
    s = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rulelake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application, whatever their search path."""
    sc = spark.sparkContext
    if getattr(sc, "_rulelake_shipped", None) is None:
        top, buffer = Path(__file__).parent, io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"{top.name}/{p.relative_to(top)}")
        path = os.path.join(tempfile.mkdtemp(prefix="rulelake-"), "rulelake_code.zip")
        Path(path).write_bytes(buffer.getvalue())
        sc.addPyFile(path)
        sc._rulelake_shipped = path
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A new local one where none is set and Spark runs
    in this process, as in tests; on a cluster, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rulelake-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    Later jobs restart from the table, whatever executors are lost meanwhile. The table goes when the application ends."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most_rows: int = 1_000_000, made_of: DataFrame | None = None) -> DataFrame:
    """df (a table of ids), to be broadcast if it has at most most_rows rows, else to be joined by merging.

    made_of: rows of which df is an aggregate, counted in its place, so that these aren't shuffled to be counted."""
    rows = df if made_of is None else made_of
    return F.broadcast(df) if rows.limit(most_rows + 1).count() <= most_rows else df.hint("merge")


def ranks(df: DataFrame, keys: list[str], order: list[Column], rank: str) -> DataFrame:
    """Add `rank`, from 0, of each row among those with its keys, in this order; rows that are equal in it may swap.

    Like a window by key, but rows are dealt by ranges of key and order, so that a key that most rows share is spread
    over all tasks. Sorted once and written; only one count per key and range is added up."""
    from pyspark.sql import Window as W

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order]
    rows = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("__part", F.shiftright("__at", 33)), "ranks")
    same = [F.col(k) for k in keys]
    per = rows.groupBy("__part", *keys).agg(F.min("__at").alias("__from"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*(same or [F.lit(0)])).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("__before", before).select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__from", "__before")
    meets = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        meets &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = rows.join(sized(per), meets).withColumn(rank, (F.col("__before") + F.col("__at") - F.col("__from")).cast("long"))
    return out.drop("__at", "__part", "__p", "__from", "__before", *[f"__k{i}" for i in range(len(keys))])
