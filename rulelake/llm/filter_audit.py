"""What each filter of a chain removes, in every order, by a Walsh-Hadamard audit.

Each document has a mask of the filters it fails. Per part, label and w the masks' signs (-1) ** (bits of mask & w) are
added up: 2 ** k parity sums over k filters, which pre-aggregate like counts. The transform is its own inverse but for
a factor, so the sums give back exactly how many documents have each mask; every order of the filters is then arithmetic
on 2 ** k cells. A document that fails f filters is removed by each of them in k! / f of the orders, which is Shapley's
closed form.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import col, cut, sized

#: A: few words. B: few distinct words. C: many capitals. D: odd characters. E: a text that a smaller id has as well.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, ODD = 100, 80, 10, b"#$%&*|"
_CAPITALS, _LATER = bytes(range(65, 91)), bytes(range(128, 192))
#: Sums and cells are kept for all documents and for those of two labels.
LABELS = ("every", "good", "toxic")


def failed(text: bytes) -> int:
    """Which of the filters A to D a text fails, as bits from the lowest."""
    words = text.split()  # of bytes: at ASCII white space
    points, capitals = len(text.translate(None, _LATER)), len(text) - len(text.translate(None, _CAPITALS))
    fails = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * points, len(text.translate(None, ODD)) < len(text))
    return sum(bit << k for k, bit in enumerate(fails))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, digest and mask (A to D) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_py() for x in b.column(2).cast(pa.large_binary())]
            digests = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), digests, pa.array(map(failed, texts), pa.int32())], names=["doc_id", "part", "digest", "mask"])

    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("part string, digest binary, mask int")]))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic: 1 if any row of labels says so of the id, else 0."""
    said = [F.coalesce(F.max((col(a) == 1).cast("int")), F.lit(0)).alias(b) for a, b in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("labelled")).agg(*said)
    named = rows.filter("doc_id is not null").join(sized(cut(known, "labels")), F.col("doc_id") == F.col("labelled"), "left").drop("labelled")
    return named.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("good", "toxic")}).unionByName(rows.filter("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))


def repeated(rows: DataFrame, bit: int) -> DataFrame:
    """part, good, toxic, mask and n: equal rows counted, after `bit` is set for texts that a smaller id has as well.

    Rows are counted by text before texts meet, so that a text that most rows share costs as many rows as parts have it. Null
    ids come after all others."""
    keys = ["digest", "part", "good", "toxic", "mask"]
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"))
    per_id = rows.groupBy("doc_id", *keys).agg(F.count("*").alias("n"))  # ids may repeat
    per_text = per_id.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(place).alias("first"), F.min_by("n", place).alias("n_first"))
    per_text = per_text.withColumn("here", F.col("first") == F.min("first").over(W.Window.partitionBy("digest")))
    alone = F.when(F.col("here"), F.col("n_first")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), alone.alias("n")), F.struct(F.col("mask").bitwiseOR(bit).alias("mask"), (F.col("n") - alone).alias("n")))
    return per_text.select("part", "good", "toxic", F.inline(both)).filter("n > 0")


def parity_sums(rows: DataFrame, k: int) -> DataFrame:
    """part, w, and the sum of signs of each label, from rows(part, good, toxic, mask, n)."""
    signs = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(2**k - 1))).alias("w"))
    signs = signs.withColumn("sign", (1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.col("w"))) % 2)) * F.col("n"))
    return signs.groupBy("part", "w").agg(F.sum("sign").alias("every"), F.sum(F.col("sign") * F.col("good")).alias("good"), F.sum(F.col("sign") * F.col("toxic")).alias("toxic"))


def cells(sums: DataFrame, k: int) -> DataFrame:
    """A row for each part: how many documents have each mask (arrays of 2 ** k), for each label."""
    rows = sums.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("w", *LABELS))).alias("s"))

    def inverted(label: str) -> Column:
        sign = lambda w, m: (1 - 2 * (F.bit_count(w.bitwiseAND(m)) % 2)).cast("long")
        of = lambda m: F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + sign(x["w"], m) * x[label])
        return F.transform(F.sequence(F.lit(0), F.lit(2**k - 1)), lambda m: F.shiftright(of(m), k)).alias(label)

    return rows.select("part", *map(inverted, LABELS))


def evaluated(counts: DataFrame, names: str) -> DataFrame:
    """Every order and step, from the cells of each part."""
    k = len(names)
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(names)])
    rows = counts.select("*", F.explode(orders).alias("filter_order"))
    bits = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.element_at(F.array(*[F.lit(1 << i) for i in range(k)]), F.instr(F.lit(names), F.substring("filter_order", i, F.lit(1)))))
    rows = rows.withColumn("bits", bits).select("*", F.posexplode("bits").alias("at", "bit"))
    rows = rows.withColumn("before", F.aggregate(F.slice("bits", 1, F.col("at")), F.lit(0), lambda a, b: a.bitwiseOR(b)))
    every = F.sequence(F.lit(0), F.lit(2**k - 1))
    zero = F.lit(0).cast("long")

    def count(label: str, wanted, worth=lambda m: F.lit(1)) -> Column:
        return F.aggregate(every, zero, lambda a, m: a + F.when(wanted(m), F.get(label, m) * worth(m)).otherwise(zero))

    fails, passed = lambda m: m.bitwiseAND(F.col("bit")) != 0, lambda m: m.bitwiseAND(F.col("before")) == 0
    here = lambda m: fails(m) & passed(m)
    share = F.array(zero, *[F.lit(math.factorial(k) // f).cast("long") for f in range(1, k + 1)])  # orders in which one of f filters is the first
    return rows.select(
        "part",
        "filter_order",
        (F.col("at") + 1).alias("step"),
        count("every", lambda m: m.bitwiseAND(F.col("before").bitwiseOR(F.col("bit"))) == 0).alias("kept"),
        count("every", here).alias("removed"),
        count("every", lambda m: fails(m) & ~passed(m)).alias("redundant"),
        count("every", lambda m: m == F.col("bit")).alias("unique_fails"),
        count("good", here).alias("good_lost"),
        count("toxic", here).alias("toxic_lost"),
        count("every", fails, lambda m: F.get(share, F.bit_count(m))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    Null texts are empty, null parts the empty string. A text is a repeat if a row with a smaller id has it in any part;
    rows that repeat an id and a text are not repeats of each other, null ids come last and have no labels. An id with
    several labels has each that any of its rows gives. An empty table gives an empty result. Only id, text and part, and of
    labels doc_id, quality and toxic are read; documents are read once."""
    k = len(FILTERS)
    rows = labelled(cut(masks(docs, id_col, text_col, part_col), "masks"), labels)
    return evaluated(cells(parity_sums(repeated(rows, 1 << (k - 1)), k), k), FILTERS)
