"""From raw documents to packed sequences: each stage's table is written, and the next stage reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelake.llm import exact_dedup, mixing, ngram_join, packing, quality_gam
from rulelake.llm.common import cut, free, partitions, sized
from rulelake.runtime import ship


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the ids that are dropped; rows without an id stay."""
    name = free("id", docs.columns)
    return docs.join(sized(dropped.select(F.col("doc_id").alias(name))), F.col("doc_id") == F.col(name), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more.

    Null, empty and blank texts have one score, that of features of 0. Of rows that repeat an id each is judged for itself; rows
    without an id are judged by their text. An empty table gives an empty one; all columns stay, whatever their names."""
    return quality_gam.keep_good(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space: the longest, then the one with the smallest id.

    Null, empty and blank texts are equal to each other. Of rows that repeat an id and a text one stays; rows that repeat an id
    with different texts are different documents, and a row without an id stays if no equal one has an id. An empty table gives
    an empty one; all columns stay, whatever their names."""
    ship(spark)
    verdict = cut(exact_dedup.exact_dedup(docs), "verdict")
    if not verdict.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return _without(docs, verdict.filter("not kept"))
    # ids repeat: by text as well
    own, ident, sha = (free(x, docs.columns) for x in ("digest", "id", "sha"))
    digest = F.sha2(F.encode(exact_dedup.normalised(F.col("text")), "UTF-8"), 256)
    kept = verdict.filter("kept").select(F.col("doc_id").alias(ident), F.col("text_sha256").alias(sha)).distinct()
    rows = docs.withColumn(own, digest)
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(own) == F.col(sha)), "left_semi")
    return rows.dropDuplicates(["doc_id", own]).drop(own)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that shares 80 of 100 word 5-grams, link by link.

    Texts without words are linked with nothing and stay, and so do rows without an id; rows that repeat an id stay or go
    together. An empty table gives an empty one; all columns stay, whatever their names."""
    ship(spark)
    groups = ngram_join.jaccard_components(docs, n=5, percent=80)
    return _without(docs, cut(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "dropped"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them (0 to 3 times), in training order.

    Texts without words, null ones among them, are taken no time, and a source of such texts gives nothing; null is a source
    like others. Rows that repeat an id, or have none, are placed each for itself. An empty table gives an empty one; all columns
    stay, whatever their names. Up to a counted number of rows, placements go to where the texts are, which move once."""
    ship(spark)
    names = docs.columns
    row, position = free("row", names), free("position", names)
    repeated = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    # the table that is read gives a row the same number each time
    rows = docs.withColumn(row, F.monotonically_increasing_id() if repeated else F.col("doc_id"))
    placed = mixing.mix(rows, id_col=row, whole=True).filter("size(placements) > 0").select(F.col("doc_id").alias(row), F.col("placements.position").alias(position))
    both = rows.join(sized(cut(placed, "placed")), row).withColumn(position, F.explode(position))
    return both.repartitionByRange(partitions(spark), position, row).sortWithinPartitions(position, row).select(*names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 4096 tokens.

    Null and empty texts are a piece of the end id alone. Rows that repeat an id, as those that the mix has repeated, are packed
    each for itself, and so are rows without one. An empty table gives an empty one; only id and text are read."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("packing", pack)]
#: Learned scores and tokenisation have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
