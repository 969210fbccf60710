"""How far the sources of a language are from each other, term by term, over deduplicated count columns.

Of a language's terms most have the same few counts in the same sources. Terms are grouped by their sparse vector of
counts by source; what a vector gives to a pair of sources is worked out once and multiplied by the number of its terms.
Pairs of sources that have a vector's terms not at all give it the same value each time, so only pairs with a count are
worked out, as the difference from that value. The terms themselves come back only to be ranked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, cut, sized

LEAST_DOCUMENTS, MOST_TERMS, SCALE = 3, 200, 1_000_000_000
#: Terms that a task counts before it gives them on.
HELD = 500_000
#: A-Z in lower case; letters and bytes of other characters as they are; all else a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", group_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it); a row without a term for each group.

    Counted in the task that reads the text, then added up, so that a common term costs a row for each task and source."""

    def told(counts: dict) -> pa.RecordBatch:
        rows = [(*group, term, n, docs[term]) for group, (every, docs) in counts.items() for term, n in every.items()]
        rows += [(*group, None, 0, 0) for group in counts]
        langs, sources, terms, n, per = zip(*rows, strict=True)
        columns = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(per, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()), strict=True):
                every, per = counts.setdefault((lang, source), (Counter(), Counter()))
                words, before = text.as_py().translate(_LETTERS).split(), len(every)
                every.update(words)
                per.update(set(words))
                held += len(every) - before
                if held >= HELD:
                    yield told(counts)
                    counts, held = {}, 0
        if counts:
            yield told(counts)

    rows = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(a) for c, a in ((group_col, "lang"), (source_col, "source"), (text_col, "text"))])
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exactly; 1 where nothing is kept."""
    whole = (count.cast("decimal(20,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(kept > 0, F.call_function("div", whole, (total + kept).cast("decimal(20,0)"))).otherwise(F.lit(0)).cast("long") + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q), of shares."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, text_col: str = "text", group_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank: each source against each other of its language (part `pair`), and its terms
    that are more common in it than in the language (part `term`, the first MOST_TERMS).

    Null text, language and source are empty. A group without terms has shares as others have, of count 0; where a language
    keeps no term, its pairs have value 0. Equal values rank by item. Rows count each for itself, whatever their ids. An empty
    table gives an empty result; only text, language and source are read, once. Counts are exact up to 10 ** 20."""
    counts = cut(term_counts(docs, text_col, group_col, source_col), "counts")
    vector = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector")
    terms = cut(counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), vector).filter(F.col("docs") >= LEAST_DOCUMENTS).drop("docs"), "terms")
    vectors = cut(terms.groupBy("lang", "vector").agg(F.count("*").alias("m")), "vectors")

    zero = F.lit(0).cast("long")
    kept = vectors.groupBy("lang").agg(F.sum("m").alias("kept"))
    totals = vectors.select("lang", "m", F.inline("vector")).groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("total"))
    groups = counts.select("lang", "source").distinct().join(kept, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["kept", "total"])
    groups = cut(groups.withColumn("zero", share(zero, F.col("total"), F.col("kept"))), "groups")
    langs = groups.groupBy("lang").agg(F.first("kept").alias("kept"), F.sum("total").alias("lang_total"), F.array_sort(F.collect_list(F.struct("source", "total", "zero"))).alias("groups"))
    few = groups.limit(1_000_001).count() <= 1_000_000
    rows = vectors.join(F.broadcast(langs) if few else langs.hint("merge"), "lang")

    n = F.map_from_entries("vector")
    by_place = F.transform("groups", lambda g: F.struct(g["zero"].alias("zero"), F.try_element_at(n, g["source"]).alias("n"), g["total"].alias("total")))
    by_place = F.transform(by_place, lambda g: F.struct(F.coalesce(F.when(g["n"].isNotNull(), share(g["n"], g["total"], F.col("kept"))), g["zero"]).alias("p"), g["zero"].alias("zero"), g["n"].isNotNull().alias("has")))
    rows = rows.withColumn("g", by_place)

    # pairs: differences from what sources without any term of the language give each other
    ends = rows.select("lang", "m", "g", F.posexplode("g").alias("s", "a")).filter("a.has").select("lang", "m", "s", "a", F.posexplode("g").alias("r", "b")).filter("s <> r")
    more = lambda x, y: (apart(F.col(x)["p"], F.col(y)["p"]) - apart(F.col(x)["zero"], F.col(y)["zero"])) * F.col("m")
    there, back = F.struct(F.col("s").alias("x"), F.col("r").alias("y"), more("a", "b").alias("value")), F.struct(F.col("r").alias("x"), F.col("s").alias("y"), more("b", "a").alias("value"))
    sums = ends.select("lang", F.inline(F.when(F.col("b")["has"], F.array(there)).otherwise(F.array(there, back)))).groupBy("lang", "x", "y").agg(F.sum("value").alias("more"))
    every = langs.select("lang", "kept", "groups", F.posexplode("groups").alias("x", "a")).select("lang", "kept", "x", "a", F.posexplode("groups").alias("y", "b")).filter("x <> y")
    pairs = every.join(sums, ["lang", "x", "y"], "left").select("lang", F.col("a")["source"].alias("source"), F.lit("pair").alias("part"), F.col("b")["source"].alias("item"), (F.col("kept") * apart(F.col("a")["zero"], F.col("b")["zero"]) + F.coalesce("more", zero)).alias("value"))

    # terms: the vectors that can be among the first, then their terms
    q = share(F.aggregate("vector", zero, lambda a, e: a + e["n"]), F.col("lang_total"), F.col("kept"))
    own = rows.withColumn("q", q).select("lang", "vector", "q", F.inline(F.arrays_zip(F.col("groups")["source"].alias("source"), F.col("g")["p"].alias("p"), F.col("g")["has"].alias("has")))).filter("has and p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    own = own.select("lang", "source", "vector", apart(F.col("p"), F.col("q")).alias("value")).withColumn("place", F.rank().over(order)).filter(F.col("place") <= MOST_TERMS).drop("place")
    found = terms.join(sized(cut(own, "first"), 100_000), ["lang", "vector"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pairs).unionByName(ranked(found).filter(F.col("rank") <= MOST_TERMS))
