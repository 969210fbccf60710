"""Repeated passages by an enhanced suffix array and its common-prefix intervals.

Which 100-byte strings occur earlier? Each has an anchor: the 32-byte gram with the smallest hash in it. Equal strings
have equal anchors, so grouping anchors by hash brings all candidates together at a few bytes a piece. An anchor's
strings form one run of text (its context). Runs equal in whole need no bytes: all but the first are removed. Only the
first of each different run with the same anchor is read: a suffix array over these contexts, with common prefix lengths,
is scanned with a stack; intervals of 100 bytes or more whose occurrences differ in the byte before are the maximal
repeats, and all their occurrences but the first are removed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, mix64, powers, sized

GRAM = 32
_RNG = np.random.default_rng(811)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
#: A run of strings: its place, and where its anchor is.
_RUN = np.dtype([("gram", "<u8"), ("print", "<u8"), ("doc", "<i8"), ("crc", "<u4"), ("lo", "<u4"), ("more", "u2"), ("at", "u2")])
_CUT = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("start", "<u4"), ("end", "<u4")])
_NO_ID = 2**63 - 1
#: Contexts of an anchor that may meet in one task.
HOT = 20_000
PACKED = "kind int, bucket long, data binary"
RUNS, CUTS, READS = 0, 1, 2


def runs(text: bytes, doc: int, width: int = 100) -> np.ndarray:
    """The runs of a text: consecutive strings of `width` bytes with the same anchor."""
    n = len(text)
    if n < width:
        return np.zeros(0, dtype=_RUN)
    power, inverse = powers(n + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[np.frombuffer(text, np.uint8)] * power[:n], dtype=np.uint64)])
    h = mix64((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    span, best = 1, np.arange(len(h), dtype=np.int32)
    while span < width - GRAM + 1:  # smallest hash of each window, by doubling; the leftmost of equal ones
        step = min(span, width - GRAM + 1 - span)
        a, b = best[:-step], best[step:]
        best = np.where(h[a] <= h[b], a, b)
        span += step
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.append(first[1:], len(best)) - 1
    out = np.zeros(len(first), dtype=_RUN)
    out["gram"], out["doc"], out["crc"], out["lo"] = h[best[first]], doc, zlib.crc32(text), first
    out["more"], out["at"] = last - first, best[first] - first
    out["print"] = mix64((sums[last + width] - sums[first]) * inverse[first] + (out["more"].astype(np.uint64) << np.uint64(8)) + out["at"])
    return out


def _packed(kind: int, rows: np.ndarray, by: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    to = (mix64(by.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    line = np.argsort(to, kind="stable")
    groups = np.split(line, np.flatnonzero(np.diff(to[line])) + 1) if len(line) else []
    return [(kind, int(to[g[0]]), rows[g].tobytes()) for g in groups]


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.table({"kind": pa.array(cols[0], pa.int32()), "bucket": pa.array(cols[1], pa.int64()), "data": pa.array(cols[2], pa.binary())})


def _cuts(r: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(r), dtype=_CUT)
    for k in ("doc", "crc"):
        out[k] = r[k]
    out["start"], out["end"] = r["lo"], r["lo"] + r["more"] + width
    return out


def _firsts(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs in order of gram, print and place, without repeats of a place; and which are the first of their print."""
    r = r[np.lexsort([r["lo"], r["crc"], r["doc"], r["print"], r["gram"]])]
    same = (r["gram"][1:] == r["gram"][:-1]) & (r["print"][1:] == r["print"][:-1])
    again = same & (r["doc"][1:] == r["doc"][:-1]) & (r["crc"][1:] == r["crc"][:-1]) & (r["lo"][1:] == r["lo"][:-1])
    keep = np.concatenate([[True], ~again]) if len(r) else np.zeros(0, bool)
    first = np.concatenate([[True], ~same]) if len(r) else np.zeros(0, bool)
    return r[keep], first[keep]


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """Ranks of all positions by their next `longest` symbols or more, by doubling."""
    rank, span = text.astype(np.int64), 1
    while span < longest:
        ahead = np.zeros(len(rank), dtype=np.int64)
        ahead[:-span] = rank[span:] + 1
        _, rank = np.unique(rank * (ahead.max() + 2) + ahead, return_inverse=True)
        span *= 2
    return rank


def maximal_repeats(contexts: list[bytes], width: int = 100) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, context of each occurrence, place in it) of every maximal repeat of `width` bytes or more.

    Repeats don't cross contexts. Occurrences that share the byte before are part of a longer repeat and not given."""
    sizes = np.array([len(c) for c in contexts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    text = np.zeros(int(sizes.sum() + len(sizes)), dtype=np.int64)
    owner, rest = np.repeat(np.arange(len(sizes)), sizes + 1), np.zeros(len(text), dtype=np.int64)
    for b, c in zip(begin, contexts, strict=True):
        text[b : b + len(c)] = np.frombuffer(c, np.uint8).astype(np.int64) + 1
        rest[b : b + len(c)] = np.arange(len(c), 0, -1)
    rank = suffix_array(text, int(sizes.max(initial=1)))
    starts = np.flatnonzero(rest >= width)
    sa = starts[np.lexsort([starts, rank[starts]])]
    # common prefixes of neighbours, at most what is left of either context
    a, b, lcp = sa[:-1], sa[1:], np.zeros(max(0, len(sa) - 1), dtype=np.int64)
    limit, live = np.minimum(rest[a], rest[b]), np.arange(max(0, len(sa) - 1))
    while len(live):
        at = lcp[live]
        go = (at < limit[live]) & (text[np.minimum(a[live] + at, len(text) - 1)] == text[np.minimum(b[live] + at, len(text) - 1)])
        live = live[go]
        lcp[live] += 1
    before = np.where(sa > 0, text[np.maximum(sa - 1, 0)], 0)
    before = np.where(before == 0, -1 - np.arange(len(sa)), before)  # a context's first byte has nothing before it
    inside = np.concatenate([[False], lcp >= width, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    for lo, hi in zip(edge[::2], edge[1::2], strict=True):  # lcp[lo:hi] belongs to suffixes lo..hi
        stack: list[tuple[int, int]] = []  # (length, left end)
        for i in range(lo, hi + 1):
            now, left = int(lcp[i]) if i < hi else 0, i
            while stack and stack[-1][0] > now:
                length, left = stack.pop()
                some = slice(left, i + 1)
                if len(np.unique(before[some])) > 1:
                    yield length, owner[sa[some]], sa[some] - begin[owner[sa[some]]]
            if now and (not stack or stack[-1][0] < now):
                stack.append((now, left))


def _by_side(contexts: DataFrame, width: int) -> DataFrame:
    """Contexts of an anchor that very many share, with a key: by the bytes after it, and again by those before it.

    A string of `width` bytes has half of what is left of it beside the anchor, or more, on one side; so equal strings have
    an equal key there. The number of bytes compared is half the width without the anchor."""
    half = (width - GRAM + 1) // 2
    after = contexts.filter(F.length("context") >= F.col("at") + GRAM + half).withColumn("key", F.xxhash64("gram", F.lit(1), F.expr(f"substring(context, cast(at as int) + {GRAM + 1}, {half})")))
    before = contexts.filter(F.col("at") >= half).withColumn("key", F.xxhash64("gram", F.lit(0), F.expr(f"substring(context, cast(at as int) - {half - 1}, {half})")))
    return after.unionByName(before)


def remove_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 24 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end pairs) of every row of docs.

    Null and empty texts have no bytes. Rows that repeat an id and a text are one document, each row with its result;
    rows that repeat an id with another text are documents of their own, in the order of the text's crc32. Null ids come
    last. An empty table gives an empty result; only id and text are read. width lies between 33 and 60,000; others are an error.
    """
    if not GRAM < width <= 60_000:
        raise ValueError(f"width lies between {GRAM + 1} and 60000, not at {width}")
    docs = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(6, int(-(-total // bucket_bytes)))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                texts = b.column(1).cast(pa.large_binary())
                every = np.concatenate([runs(t.as_py(), _NO_ID if d is None else d, width) for d, t in zip(b.column(0).to_pylist(), texts, strict=True)])
                every, first = _firsts(every)
                again = _cuts(every[~first], width)
                rows = _packed(RUNS, every[first], every["gram"][first], buckets) + _packed(CUTS, again, again["doc"].view(np.uint64), buckets)
                yield from _table(rows).to_batches()

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        r, first = _firsts(np.frombuffer(b"".join(t.column("data").to_pylist()), dtype=_RUN))
        again, reps = _cuts(r[~first], width), r[first]
        near = np.concatenate([[False], reps["gram"][1:] == reps["gram"][:-1], [False]])
        reads = reps[near[1:] | near[:-1]]
        return _table(_packed(CUTS, again, again["doc"].view(np.uint64), buckets) + _packed(READS, reads, reads["doc"].view(np.uint64), buckets))

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                ids = np.array([_NO_ID if d is None else d for d in b.column(0).to_pylist()], dtype=np.int64)
                to = (mix64(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(to), b.column(0), pa.array([z.compress(t.as_py()) for t in b.column(1).cast(pa.large_binary())], pa.binary())], names=["bucket", "doc_id", "z"])

    def texts(t: pa.Table) -> Iterator[tuple[int | None, bytes]]:
        z = zstandard.ZstdDecompressor()
        for d, x in zip(t.column("doc_id").to_pylist(), t.column("z").to_pylist(), strict=True):
            yield d, z.decompress(x)

    def read(key: tuple, t: pa.Table, wanted: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(wanted.column("data").to_pylist()), dtype=_RUN)
        r = r[np.lexsort([r["crc"], r["doc"]])]
        ids, first = np.unique(r[["doc", "crc"]], return_index=True)
        at = {(int(i["doc"]), int(i["crc"])): s for i, s in zip(ids, np.split(r, first[1:]) if len(first) else [], strict=True)}
        out, have = [], {x for x, _ in at}
        for d, text in texts(t) if len(r) else ():
            d = _NO_ID if d is None else d
            if d in have and (some := at.pop((d, zlib.crc32(text)), None)) is not None:
                for x in some:
                    lo = int(x["lo"])
                    out.append((int(x["gram"] >> np.uint64(1)), d, int(x["crc"]), lo, int(x["at"]), text[lo : lo + int(x["more"]) + width]))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        return pa.table({k: pa.array(c, pa.binary() if k == "context" else pa.int64()) for k, c in zip(("gram", "doc", "crc", "lo", "at", "context"), cols, strict=True)})

    def repeats(key: tuple, t: pa.Table) -> pa.Table:
        doc, crc, lo = (t.column(k).to_numpy() for k in ("doc", "crc", "lo"))
        contexts = t.column("context").to_pylist()
        found = [np.zeros(0, dtype=_CUT)]
        for length, who, place in maximal_repeats(contexts, width):
            at = lo[who] + place
            order = np.lexsort([at, crc[who], doc[who]])
            first = order[0]
            later = (doc[who] != doc[who[first]]) | (crc[who] != crc[who[first]]) | (at != at[first])
            c = np.zeros(int(later.sum()), dtype=_CUT)
            c["doc"], c["crc"], c["start"], c["end"] = doc[who[later]], crc[who[later]], at[later], at[later] + length
            found.append(c)
        c = np.unique(np.concatenate(found))
        return _table(_packed(CUTS, c, c["doc"].view(np.uint64), buckets))

    def finish(key: tuple, t: pa.Table, given: pa.Table) -> pa.Table:
        c = np.frombuffer(b"".join(given.column("data").to_pylist()), dtype=_CUT)
        c = c[np.lexsort([c["start"], c["crc"], c["doc"]])]
        ids, first = np.unique(c[["doc", "crc"]], return_index=True)
        at = {(int(i["doc"]), int(i["crc"])): s for i, s in zip(ids, np.split(c, first[1:]) if len(first) else [], strict=True)}
        rows, have = [], {x for x, _ in at}
        for d, text in texts(t):
            key = _NO_ID if d is None else d
            spans: list[list[int]] = []
            if key in have and (some := at.get((key, zlib.crc32(text)))) is not None:
                for s, e in zip(some["start"].tolist(), some["end"].tolist(), strict=True):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
            gone, end, left = sum(e - s for s, e in spans), 0, hashlib.sha256()
            for s, e in spans:
                left.update(text[end:s])
                end = e
            left.update(text[end:])
            rows.append((d, len(text), gone, len(spans), left.hexdigest(), [x for s in spans for x in s]))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        return pa.table({k: pa.array(x, y) for k, x, y in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"), cols, kinds, strict=True)})

    dealt = cut(docs.mapInArrow(anchors, PACKED), "runs")
    met = cut(dealt.filter(f"kind = {RUNS}").groupBy("bucket").applyInArrow(meet, PACKED), "met")
    bodies = docs.mapInArrow(squeezed, "bucket long, doc_id long, z binary")
    contexts = bodies.groupBy("bucket").cogroup(met.filter(f"kind = {READS}").groupBy("bucket")).applyInArrow(read, "gram long, doc long, crc long, lo long, at long, context binary")
    contexts = cut(contexts, "contexts")
    size = contexts.agg(F.sum(F.length("context"))).first()[0] or 0
    parts = max(6, int(-(-size // (1 << 20))))
    hot = sized(contexts.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("gram"))
    rest = contexts.join(hot, "gram", "left_anti").withColumn("key", F.xxhash64("gram"))
    inner = rest.unionByName(_by_side(contexts.join(hot, "gram", "left_semi"), width)).withColumn("part", F.pmod("key", F.lit(parts))).groupBy("part").applyInArrow(repeats, PACKED)
    cuts = dealt.filter(f"kind = {CUTS}").unionByName(met.filter(f"kind = {CUTS}")).unionByName(inner)
    return bodies.groupBy("bucket").cogroup(cuts.groupBy("bucket")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
