"""Exact duplicates by static binary-fuse filters of an immutable snapshot.

Digests of a snapshot are spread over buckets, and a binary-fuse filter (about nine bits a digest) is built for each.
Incoming digests are grouped among themselves first, then screened by their bucket's filter. Only those that pass meet
the exact digests of the snapshot, where the normalised bytes of one representative of each side are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, col, cut, mix64, sized

FILTER = "bucket long, seed long, segment_length long, segments long, fingerprints binary"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "")


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """Three slots of each hash, in neighbouring segments."""
    first = (((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64) * length
    mask = np.uint64(length - 1)
    return np.stack([first + (h & mask).astype(np.int64), first + length + ((h >> np.uint64(18)) & mask).astype(np.int64), first + 2 * length + ((h >> np.uint64(36)) & mask).astype(np.int64)])


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, segments, fingerprints) of distinct 64-bit keys.

    Keys are peeled in rounds: whatever is alone in a slot goes first and is assigned last."""
    n = len(keys)
    length = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    room = max(n * (1.125 if n > 2 else 4), n * (0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2.0))), 8)
    segments = max(1, int(np.ceil(room / length)) - 2)
    for seed in range(1, 1000):
        h = mix64(keys + np.uint64(seed))
        slots = _slots(h, length, segments)
        size = (segments + 2) * length
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, dtype=np.int64)
        for s in slots:  # the sum of the keys in a slot names the last one left
            np.add.at(owner, s, np.arange(n))
        alive, order = np.ones(n, dtype=bool), []
        front = np.flatnonzero(count == 1)
        while len(front):
            who, at = np.unique(owner[front], return_index=True)
            order.append((who, front[at]))
            alive[who] = False
            for s in slots:
                np.subtract.at(count, s[who], 1)
                np.subtract.at(owner, s[who], who)
            near = np.unique(slots[:, who].ravel())
            front = near[count[near] == 1]
        if alive.any():
            if seed % 8 == 0:
                segments += max(1, segments // 10)
            continue
        table, prints = np.zeros(size, dtype=np.uint8), _prints(h)
        for who, at in reversed(order):
            table[at] = 0
            table[at] = prints[who] ^ table[slots[0, who]] ^ table[slots[1, who]] ^ table[slots[2, who]]
        return seed, length, segments, table
    raise RuntimeError("no seed peels these keys; are they distinct?")


def may_contain(keys: np.ndarray, seed: int, length: int, segments: int, table: np.ndarray) -> np.ndarray:
    h = mix64(keys + np.uint64(seed))
    a, b, c = _slots(h, length, segments)
    return _prints(h) == (table[a] ^ table[b] ^ table[c])


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([int.from_bytes(x[8:16], "little") for x in column.to_pylist()], dtype=np.uint64)


def _build(key: tuple, t: pa.Table) -> pa.Table:
    seed, length, segments, table = build_filter(np.unique(_keys(t["digest"])))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "seed": pa.array([seed], pa.int64()), "segment_length": pa.array([length], pa.int64()), "segments": pa.array([segments], pa.int64()), "fingerprints": pa.array([table.tobytes()], pa.binary())})


def _screen(incoming: pa.Table, filters: pa.Table) -> pa.Table:
    if not incoming.num_rows or not filters.num_rows:
        return incoming.select(["digest"]).slice(0, 0)
    f = filters.to_pylist()[0]
    hit = may_contain(_keys(incoming["digest"]), f["seed"], f["segment_length"], f["segments"], np.frombuffer(f["fingerprints"], np.uint8))
    return incoming.select(["digest"]).filter(pa.array(hit))


def _bucket(n: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(n))


def classes(d: DataFrame) -> DataFrame:
    """One row per digest: n rows and the best row (most code points, then smallest id); combined before the shuffle."""
    best = F.max(F.struct(F.col("n_points").alias("p"), (-F.col("doc_id")).alias("m"), F.col("doc_id").alias("id"))).alias("best")
    return d.groupBy("digest").agg(F.count("*").alias("n"), best)


def snapshot_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """A filter for each bucket of a snapshot's distinct digests."""
    return snapshot.select("digest", _bucket(buckets).alias("bucket")).groupBy("bucket").applyInArrow(_build, FILTER)


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The incoming distinct digests that the snapshot may hold (one in about 256 of the others passes as well)."""
    left = incoming.select("digest", _bucket(buckets).alias("bucket")).groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInArrow(_screen, "digest binary")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", in_snapshot: Column | None = None, keys_per_bucket: int = 200_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and from_snapshot for every row of docs.

    in_snapshot tells the rows of the immutable snapshot from the new batch; by default half of the ids, by a hash.
    Null and empty texts are equal to each other and to blank ones. Of rows that repeat an id and a text, each is
    counted, and each of those with the kept id is marked kept. An empty table gives an empty result; other columns are not read.
    """
    side = F.coalesce(in_snapshot, F.lit(False)) if in_snapshot is not None else F.pmod(F.xxhash64(col(id_col)), F.lit(2)) == 0
    base = docs.select(col(id_col).alias("doc_id"), F.unhex(F.sha2(F.encode(normalised(col(text_col)), "UTF-8"), 256)).alias("digest"), F.char_length(F.coalesce(col(text_col), F.lit(""))).cast("long").alias("n_points"), side.alias("from_snapshot"))
    d = cut(base, "digests")
    old, new = classes(d.filter("from_snapshot")), classes(d.filter("not from_snapshot"))
    buckets = max(1, -(-d.count() // keys_per_bucket))
    hits = screen(new, snapshot_filters(old, buckets), buckets)
    met = cut(new.join(hits, "digest", "left_semi").join(old.withColumnsRenamed({"n": "n_old", "best": "best_old"}), "digest"), "met")
    # the bytes of one representative of each side; their ids are broadcast only up to a number
    ids = met.select("digest", F.explode(F.array(F.struct("best.id", F.lit(False).alias("old")), F.struct("best_old.id", F.lit(True).alias("old")))).alias("r")).select("digest", "r.*")
    found = sized(ids.select(F.col("id").alias("__id"), F.col("old").alias("__old"), "digest"))
    bodies = docs.select(col(id_col).alias("id"), normalised(col(text_col)).alias("body"), side.alias("old")).join(found, F.col("id").eqNullSafe(F.col("__id")) & (F.col("old") == F.col("__old")))
    bodies = bodies.withColumn("same", F.unhex(F.sha2(F.encode("body", "UTF-8"), 256)) == F.col("digest")).filter("same")
    # one body, and both sides are there
    equal = bodies.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most"), F.bool_or("old").alias("seen"), F.bool_or(~F.col("old")).alias("new")).filter("least = most and seen and new")
    one = met.join(equal, "digest", "left_semi").select("digest", (F.col("n") + F.col("n_old")).alias("n_all"), F.greatest("best", "best_old").alias("best_all"))
    both = new.withColumn("from_snapshot", F.lit(False)).unionByName(old.withColumn("from_snapshot", F.lit(True))).join(one, "digest", "left")
    both = both.select("digest", "from_snapshot", F.coalesce("n_all", "n").alias("group_size"), F.coalesce("best_all", "best").getField("id").alias("keep_id"))
    return d.join(both, ["digest", "from_snapshot"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "from_snapshot")
