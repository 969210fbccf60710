"""Walks over a graph of (a, b) edges: closure, reachability from starts, shortest paths.

Edges up to a checked number are broadcast, and each start is walked where it is. Of a larger graph, connected components up to
that number are dealt to tasks and walked there. A larger component is walked by joins, round after round, each written to the
shared folder: plans don't grow, and a lost executor costs one round. No walk has a limit of depth; it ends when nothing is new."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Edges up to which a graph is broadcast (about 100 bytes each in a worker).
MOST_EDGES = 1_000_000
#: Edges of a task that walks whole components; larger ones are tasks of their own.
TASK_EDGES = 100_000
_BATCH = 20_000


def _small(edges: DataFrame, most: int) -> dict[str, list[str]] | None:
    """Sorted successors of each node, if the graph has at most `most` edges."""
    if edges.limit(most + 1).count() > most:  # counted first: nothing of a large graph comes to the driver
        return None
    rows = edges.collect()
    out = defaultdict(set)
    for a, b in rows:
        out[a].add(b)
    return {a: sorted(b) for a, b in out.items()}


def _batches(rows: Iterator[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    cols: list[list] = [[] for _ in names]
    for r in rows:
        for c, v in zip(cols, r, strict=True):
            c.append(v)
        if len(cols[0]) >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
            cols = [[] for _ in names]
    if cols[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _reached(after: dict[str, list[str]], start: str) -> Iterator[tuple]:
    seen, stack = set(), list(after.get(start, ()))
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            yield start, x
            stack += after.get(x, ())


def _paths(after: dict[str, list[str]], start: str) -> Iterator[tuple]:
    path, front = {start: [start]}, [start]
    yield start, start, [start]
    while front:
        further = []
        for x in front:  # in the order of their paths, successors by name
            for y in after.get(x, ()):
                if y not in path:
                    path[y] = [*path[x], y]
                    further.append(y)
                    yield start, y, path[y]
        front = further


_KINDS = {"reach": (_reached, "start string, node string", ["start", "node"]), "paths": (_paths, "start string, node string, path array<string>", ["start", "node", "path"])}


def _walked(kind: str, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = _KINDS[kind][2]
    return _batches(rows, [pa.string(), pa.string(), pa.list_(pa.string())][: len(names)], names)


def _everywhere(kind: str, graph: dict[str, list[str]], starts: DataFrame) -> DataFrame:
    """Each start is walked where it is, over a broadcast graph."""
    shared, f = starts.sparkSession.sparkContext.broadcast(graph), _KINDS[kind][0]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _walked(kind, (r for b in batches for start in b.column(0).to_pylist() for r in f(shared.value, start)))

    return starts.mapInArrow(walk, _KINDS[kind][1])


def _labels(edges: DataFrame) -> DataFrame:
    """node and label (the smallest name of its connected component), by alternating large and small stars."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), *[F.sum(h("a", "b").cast("decimal(38,0)")) for h in (F.xxhash64, F.hash)]).first())

    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before, after = None, state(now)
    while before != after:
        now = cut(star(star(now, True), False), "stars")
        before, after = after, state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _by_component(kind: str, e: DataFrame, s: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What starts in components of at most `most` edges reach, walked in tasks that hold whole components; edges and starts of the
    others. A start without an edge is a component of its own."""
    labels = cut(_labels(e), "labels")
    named = cut(e.join(labels, F.col("a") == F.col("node"), "left").select(F.coalesce("label", "a").alias("label"), "a", "b"), "named")
    starts = cut(s.join(labels, F.col("start") == F.col("node"), "left").select(F.coalesce("label", "start").alias("label"), "start"), "starts")
    large = cut(named.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("label"), "large")
    whole = named.join(large, "label", "left_anti").unionByName(starts.join(large, "label", "left_anti").select("label", F.col("start").alias("a"), F.lit(None).cast("string").alias("b")))
    f = _KINDS[kind][0]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, some = defaultdict(list), []
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b is None:
                    some.append(a)
                else:
                    after[a].append(b)
        graph = {a: sorted(b) for a, b in after.items()}
        yield from _walked(kind, (r for start in some for r in f(graph, start)))

    out = whole.repartition(max(1, named.count() // TASK_EDGES), "label").select("a", "b").mapInArrow(walk, _KINDS[kind][1])
    return out, named.join(large, "label", "left_semi").select("a", "b"), starts.join(large, "label", "left_semi").select("start")


def reach(edges: DataFrame, starts: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """Distinct (start, node) with a path of at least one edge from start to node. edges(a, b), starts(start), all strings.

    A start is its own node only if it is on a cycle. Rows with a null are left out; repeated ones count once. Where half of the edges
    lead to leaves with one parent, the rest is walked first, and the leaves join what their parents are reached from."""
    e = edges.toDF("a", "b").filter("a is not null and b is not null").distinct()
    s = starts.toDF("start").filter("start is not null").distinct()
    graph = _small(e, most_edges)
    if graph is not None:
        return _everywhere("reach", graph, s)
    e, s = cut(e, "edges"), cut(s, "starts")
    single = e.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("a")).filter("n = 1").select("a", "b")
    leaves = cut(single.join(e.select(F.col("a").alias("b")).distinct(), "b", "left_anti").select("a", "b"), "leaves")
    if 2 * leaves.count() >= e.count():
        near = cut(reach(e.join(leaves.select("b"), "b", "left_anti").select("a", "b"), s, most_edges), "near")
        via = s.select("start", F.col("start").alias("a")).unionByName(near.filter("start <> node").select("start", F.col("node").alias("a")))
        return near.unionByName(via.join(leaves, "a").select("start", F.col("b").alias("node")))
    out, e, s = _by_component("reach", e, s, most_edges)
    if not e.limit(1).count():
        return out
    e = cut(e, "edges")
    every = new = cut(s.join(e, F.col("start") == F.col("a")).select("start", F.col("b").alias("node")).distinct(), "reached")
    while new.limit(1).count():
        step = new.join(e, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
        new = cut(step.join(every, ["start", "node"], "left_anti"), "reached")
        every = every.unionByName(new)
    return out.unionByName(every)


def closure(edges: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """Distinct (a, b) with a path of at least one edge from a to b; cycles end. edges(a, b), strings.

    Beyond most_edges, each round joins the pairs that are new with all known ones, which doubles the length of the paths
    it knows: as many rounds as the longest shortest path has binary digits."""
    e = edges.toDF("a", "b").filter("a is not null and b is not null").distinct()
    if e.limit(most_edges + 1).count() <= most_edges:
        return reach(e, e.select("a").distinct(), most_edges).toDF("a", "b")
    every = new = cut(e, "closure")
    while new.limit(1).count():
        step = new.join(every.toDF("b", "c"), "b").select("a", F.col("c").alias("b")).distinct()
        new = cut(step.join(every, ["a", "b"], "left_anti"), "closure")
        every = cut(every.unionByName(new), "closure")
    return every


def shortest(edges: DataFrame, starts: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """(start, node, path) for every node that a start reaches, itself with a path of one. Breadth first: the path has the
    fewest edges, and of those the one whose names come first, from its start on."""
    e = edges.toDF("a", "b").filter("a is not null and b is not null").distinct()
    s = starts.toDF("start").filter("start is not null").distinct()
    graph = _small(e, most_edges)
    if graph is not None:
        return _everywhere("paths", graph, s)
    out, e, s = _by_component("paths", cut(e, "edges"), cut(s, "starts"), most_edges)
    if not e.limit(1).count():
        return out
    e = cut(e, "edges")
    every = new = cut(s.select("start", F.col("start").alias("node"), F.array("start").alias("path")), "paths")
    while new.limit(1).count():
        step = new.join(e, F.col("node") == F.col("a")).select("start", F.col("b").alias("node"), F.array_append("path", F.col("b")).alias("path"))
        step = step.groupBy("start", "node").agg(F.min("path").alias("path"))
        new = cut(step.join(every.select("start", "node"), ["start", "node"], "left_anti"), "paths")
        every = every.unionByName(new)
    return out.unionByName(every)
