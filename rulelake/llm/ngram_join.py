"""N-gram Jaccard join by vertical partitioning, and its components.

Word n-grams have one global order, by how many documents have them as far as sketches tell, which is cut into
fragments. One sketch has counters in proportion to the grams, which stay where they are added up: of each, two bits for how
many it counts come back. Sums of its counters are the other one, of fixed size. Two similar sets share grams among their
first ones (prefixes), the more the larger they are, so groups by prefix gram give candidates. What candidates can't have in
common is bounded from below, by how many grams each has in each of 16 fragments, and then by a bitmap of parities. Candidates
that pass form clusters. A cluster's grams meet in blocks: there, a pair's common grams are counted fragment by fragment, apart from each
other, and the partial counts are summed per pair.

Equal sets are joined once. No pairs of a large group of a frequent gram are listed: its members form one cluster. A gram that
isn't frequent has few members. Of a large cluster, blocks
are counted together with a few leaders first. Then its members outside the main component meet all others, as finer bitmaps
in blocks: each with its nearest partners first, and, while they are in different components, with all that the bitmaps
allow. A block returns a spanning forest of its links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, col, cut, freeing, mix64, powers, sized
from .components import components

#: Where the order of the grams that aren't frequent is cut for counting; those are the last fragment.
CUTS = (2**61, 9 * 2**60)
#: Fragments whose sizes are compared first: the highest bits of a gram say which.
BINS = 16
#: Counters of the small sketch; deviations above its mean that make a gram frequent.
COUNTERS, DEVIATIONS = 1 << 19, 5
#: Bytes of text per counter of the large sketch, its least counters, those that a task adds up at once, counters per level that comes
#: back, and the most levels.
PER, LEAST, SLICE, FOLD, LEVELS = 5, 1 << 20, 1 << 20, 4, 1 << 28
#: Documents that a gram of each level but the last has at most.
STEPS = (4, 16, 64)
#: Members of a frequent gram beyond which no pair of its group is listed; pairs a member above which none is; leaders of a large cluster.
LARGE, DENSE, LEADERS = 4096, 8, 4
#: Members beyond which a group is treated as a frequent gram's, whatever the sketch has told of the gram.
OWN = 256
#: Grams per further common gram that a pair must have in its prefixes.
FURTHER = 100
#: Members and grams of a block that is counted, and members of a block of bitmaps.
BLOCK, GRAMS, SCREENED = 1024, 1 << 21, 4096
#: Members of a frequent prefix gram that may meet in one task.
HOT = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(20240)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[[ord(c) for c in SPACE_CHARS]] = 0
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def gram_hashes(text: bytes | None, n: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams, A-Z lowered; the whole sequence as one if it is shorter."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    x = _BYTE[np.frombuffer(text.translate(_LOWER), dtype=np.uint8)]
    word = np.concatenate([[False], x != 0, [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = powers(len(x) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x * power[: len(x)], dtype=np.uint64)])
    w = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    k = min(n, len(w))
    total = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total += w[i : len(w) - k + 1 + i] * _PLACE[i]
    return np.unique(mix64(total))


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


_LOW = np.uint64((1 << 48) - 1)


class Order:
    """The global order of grams: by the large sketch's level and then by hash, and at the end those of which the small
    one counts more than of most others, rarer first. The sketches never count too few documents.

    Both have a row per slice, which a gram's lowest bits tell; levels are two bits each."""

    def __init__(self, counts: np.ndarray, levels: np.ndarray):
        self.counts, self.levels, self.hot = counts, levels, HOT
        self.mean = float(counts.mean())
        self.limit = self.mean + DEVIATIONS * max(1.0, float(np.sqrt(self.mean)))

    def count(self, h: np.ndarray) -> np.ndarray:
        return self.counts[_place(h, *self.counts.shape)]

    def level(self, h: np.ndarray) -> np.ndarray:
        at, within = _place(h, len(self.levels), 4 * self.levels.shape[1])
        return (self.levels[at, within >> 2] >> (2 * (within & 3)).astype(np.uint8)) & np.uint8(3)

    def frequent(self, h: np.ndarray) -> np.ndarray:
        return self.count(h) > self.limit

    def salts(self, h: np.ndarray) -> np.ndarray:
        """To how many tasks the members of a frequent prefix gram are dealt."""
        return np.maximum(1, np.ceil((self.count(h) - self.mean) / self.hot)).astype(np.uint64)

    def sort(self, h: np.ndarray) -> tuple[np.ndarray, int]:
        """The grams in order, and how many of them are of the lowest level."""
        level = self.level(h)
        common = np.flatnonzero(level)
        if not len(common):
            return h, len(h)
        some, key = h[common], level[common].astype(np.int64)
        top = key == len(STEPS)
        c = self.count(some[top])
        key[top] += np.where(c > self.limit, c, 0)
        return np.concatenate([h[level == 0], some[np.argsort(key, kind="stable")]]), len(h) - len(common)


def _place(h: np.ndarray, slices: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The slice of each gram, and its place among `size` counters there; both are powers of 2."""
    m = mix64(h & _LOW)
    return (m & np.uint64(slices - 1)).astype(np.int64), ((m >> np.uint64(slices.bit_length() - 1)) & np.uint64(size - 1)).astype(np.int64)


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _texts(b: pa.RecordBatch, k: int) -> Iterator[bytes | None]:
    return (x.as_py() for x in b.column(k).cast(pa.large_binary()))


def _gaps(at: np.ndarray) -> bytes:
    """Sorted numbers as their differences: how many bytes of each, then all lowest bytes, all next ones and so on."""
    gaps = np.diff(at, prepend=at.dtype.type(0)).astype("<u4")
    k = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([k]) + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4)[:, :k].T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    """What _gaps was given."""
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    return np.cumsum(sum(x.astype(np.int64) << (8 * i) for i, x in enumerate(planes)))


def _order(docs: DataFrame, n: int) -> Order:
    """The order that sketches of all documents give: each gram of a document adds one to one of the counters, of which a task
    adds up a slice. What comes back has a fixed bound: COUNTERS sums and at most LEVELS levels."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = 1 << max(LEAST.bit_length(), (size // PER).bit_length()) - 1
    slices = min(max(16, counters // SLICE), COUNTERS)
    kind = np.uint32 if counters <= 1 << 32 else np.uint64
    own, levels = counters // slices, min(counters // FOLD, LEVELS) // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def rows() -> pa.RecordBatch:
            at, within = _place(np.concatenate([np.zeros(0, np.uint64), *waiting]), slices, own)
            key = np.sort((at * own + within).astype(kind))
            ends = [*np.searchsorted(key, (np.arange(slices) * own).astype(kind)), len(key)]
            some = [k for k in range(slices) if ends[k] < ends[k + 1]]
            parts = [_gaps(key[ends[k] : ends[k + 1]] - kind(k * own)) for k in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counted"])

        for b in batches:
            for t in _texts(b, 0):
                h = gram_hashes(t, n)
                waiting.append(h)
                held += len(h)
                if held > SLICE:
                    yield rows()
                    waiting, held = [], 0
        yield rows()

    def add_up(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(own, dtype=np.int64)
        for x in t.column("counted"):
            total += np.bincount(_numbers(x.as_py()), minlength=own)
        level = np.searchsorted(np.array(STEPS), total).astype(np.uint8).reshape(-1, levels).max(0)  # counters that share a place give it the highest
        packed = (level.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
        sums = total.reshape(-1, COUNTERS // slices).sum(0)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary()), "levels": pa.array([packed.tobytes()], pa.binary())})

    found = docs.select("text").mapInArrow(freeing(count), "slice int, counted binary").groupBy("slice").applyInArrow(freeing(add_up), "slice int, sums binary, levels binary").collect()
    sums, packed = np.zeros((slices, COUNTERS // slices), dtype=np.int64), np.zeros((slices, levels // 4), dtype=np.uint8)
    for r in found:
        sums[r["slice"]], packed[r["slice"]] = np.frombuffer(r["sums"], np.int64), np.frombuffer(r["levels"], np.uint8)
    return Order(sums, packed)


def _sketch(h: np.ndarray, fine: int = 2) -> bytes:
    """A bitmap of at least `fine` bits a gram: each bit tells whether an odd number of grams falls on it."""
    bits = max(64, 1 << (fine * len(h) - 1).bit_length())
    at = (mix64(h + np.uint64(77)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


SETS = "doc_id long, n_grams long, digest binary, prefix binary, sizes binary, sketch binary"


def _prefixes(docs: DataFrame, order, n: int, percent: int) -> DataFrame:
    """doc_id, n_grams, digest of the set, its prefix (six bytes a gram), the sizes of its fragments (clipped at 255) and its bitmap."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                out: list[list] = [[], [], [], [], []]
                for t in _texts(b, 1):
                    h = gram_hashes(t, n)
                    size = len(h)
                    if not size:
                        for o, v in zip(out, (0, None, b"", b"", b""), strict=True):
                            o.append(v)
                        continue
                    first = order.value.sort(h)[0][: size - _least_overlap(size, percent) + 1 + size // FURTHER]
                    prefix = np.ascontiguousarray(first.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                    sizes = np.minimum(np.bincount((h >> np.uint64(60)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()
                    for o, v in zip(out, (size, hashlib.blake2b(h.tobytes(), digest_size=16).digest(), prefix, sizes, _sketch(h)), strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), *[pa.array(o, pa.binary()) for o in out[1:]]], names=[x.split()[0] for x in SETS.split(", ")])

    return docs.mapInArrow(freeing(rows), SETS)


_MEMBER = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("n", "<u4"), ("at", "<u4"), ("sizes", "u1", BINS)])


def _deal(reps: DataFrame, order, buckets: int) -> DataFrame:
    """Prefix grams with their documents, packed by bucket: (bucket, members). Those of hot grams are salted by document."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 5000):
                b = whole.slice(start, 5000)
                parts = []
                for doc, n, raw, sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    k = len(raw) // 6
                    m = np.zeros(k, dtype=_MEMBER)
                    g = np.zeros((k, 8), dtype=np.uint8)
                    g[:, :6] = np.frombuffer(raw, np.uint8).reshape(k, 6)
                    m["gram"] = g.view(np.uint64).ravel()
                    m["doc"], m["n"], m["at"], m["sizes"] = doc, n, np.arange(k), np.frombuffer(sizes, np.uint8)
                    parts.append(m)
                every = np.concatenate(parts) if parts else np.zeros(0, dtype=_MEMBER)
                spread = every["gram"].copy()
                salts = order.value.salts(spread)
                salted = salts > 1
                if salted.any():
                    spread[salted] += np.uint64(1 << 50) * (np.uint64(1) + mix64(every["doc"][salted].view(np.uint64)) % salts[salted])
                to = (mix64(spread) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[by])) + 1
                groups = np.split(by, cuts) if len(by) else []
                yield pa.RecordBatch.from_arrays([pa.array([int(to[g[0]]) for g in groups], pa.int64()), pa.array([every[g].tobytes() for g in groups], pa.binary())], names=["bucket", "members"])

    return reps.select("doc_id", "n_grams", "prefix", "sizes").mapInArrow(freeing(deal), "bucket long, members binary")


def _candidates(percent: int, order):
    own = OWN

    def find(key: tuple, t: pa.Table) -> pa.Table:
        m = np.frombuffer(b"".join(t.column("members").to_pylist()), dtype=_MEMBER)
        m = m[np.lexsort([m["doc"], m["gram"]])]
        starts = np.flatnonzero(np.concatenate([[True], m["gram"][1:] != m["gram"][:-1]])) if len(m) else np.zeros(0, int)
        counts = np.diff(np.append(starts, len(m)))
        pairs, members = [], []

        def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Whether neither the sizes nor those of the fragments differ too much."""
            na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
            ok = (a["doc"] != b["doc"]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            i = np.nonzero(ok)
            a, b = np.broadcast_to(a, ok.shape)[i], np.broadcast_to(b, ok.shape)[i]
            apart = np.abs(a["sizes"].astype(np.int16) - b["sizes"].astype(np.int16)).sum(1, dtype=np.int64)
            ok[i] = apart * (100 + percent) <= (100 - percent) * (a["n"].astype(np.int64) + b["n"].astype(np.int64))
            return ok

        def listed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """(a, b, whether the rest after this gram suffices if it is their first, common grams needed) of pairs."""
            na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
            early = (1 + np.minimum(na - a["at"] - 1, nb - b["at"] - 1)) * (100 + percent) >= percent * (na + nb)
            return np.stack([np.minimum(a["doc"], b["doc"]), np.maximum(a["doc"], b["doc"]), early, 1 + np.minimum(na, nb) // FURTHER], 1)

        salted, often = order.value.salts(m["gram"][starts]) > 1, order.value.frequent(m["gram"][starts]) | (counts > own)
        large = (counts > 16) | salted
        for size in np.unique(counts[(counts > 1) & ~large]):
            at = starts[(counts == size) & ~large]
            for i in range(size):
                for j in range(i + 1, size):
                    a, b = m[at + i], m[at + j]
                    ok = fits(a, b)
                    pairs.append(listed(a[ok], b[ok]))
        for s, size, split, frequent in zip(starts[large], counts[large], salted[large], often[large], strict=True):
            g = m[s : s + size]
            most = DENSE * size if frequent and size > 4 * DENSE else size * size
            dense = split or frequent and size > LARGE
            if not dense:
                some, found = [], 0
                for e in np.array_split(np.arange(size), size // 256 + 1):
                    i, j = np.nonzero(fits(g[e][:, None], g[None, e[0] :]))
                    i, j = e[i], e[0] + j
                    i, j = i[i < j], j[i < j]
                    found += len(i)
                    if found > most:
                        break  # all members are of one cluster
                    some.append(listed(g[i], g[j]))
                else:
                    pairs += some
                    continue
            members.append((int(g["gram"][0]), np.unique(g["doc"])))
        p = np.concatenate([np.zeros((0, 4), dtype=np.int64), *pairs])
        p = p[np.lexsort([p[:, 1], p[:, 0]])]
        new = np.flatnonzero(np.concatenate([[True], (p[1:, :2] != p[:-1, :2]).any(1)])) if len(p) else np.zeros(0, int)
        out = np.stack([p[new, 0], p[new, 1], np.diff(np.append(new, len(p))), np.maximum.reduceat(p[:, 2], new), p[new, 3]], 1) if len(p) else np.zeros((0, 5), np.int64)
        first = np.flatnonzero(np.concatenate([[True], out[1:, 0] != out[:-1, 0]])) if len(out) else np.zeros(0, int)
        ends, none = len(out) + np.cumsum([0, *(len(d) for _, d in members)]), np.full(len(members) + 1, len(out))
        lists = lambda values, rest: pa.ListArray.from_arrays(pa.array(np.concatenate([first, rest]), pa.int32()), pa.array(values, pa.int64()))
        docs = lists(np.concatenate([out[:, 1], *(d for _, d in members)]).astype(np.int64), ends)
        kinds = pa.array(np.repeat([0, 1], [len(first), len(members)]), pa.int32())
        heads = pa.array([*out[first, 0].tolist(), *(x for x, _ in members)], pa.int64())
        return pa.table([kinds, heads, docs, *(lists(np.ascontiguousarray(out[:, k]), none) for k in (2, 3, 4))], names=["kind", "a", "docs", "times", "early", "need"])

    return find


def _paired(key: tuple, t: pa.Table) -> pa.Table:
    """The pairs (a, b) that have enough common grams in all groups together, and one early enough. All rows of an a meet."""
    t = t.sort_by("a")
    a = t.column("a").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)
    cols = [t.column(k).combine_chunks() for k in ("docs", "times", "early", "need")]
    out: list[np.ndarray] = [np.zeros((0, 2), dtype=np.int64)]
    for lo, hi in zip(first, [*first[1:], len(a)], strict=True):
        b, times, early, need = (c.slice(lo, hi - lo).flatten().to_numpy() for c in cols)
        by = np.argsort(b, kind="stable")
        b, times, early, need = b[by], times[by], early[by], need[by]
        at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, int)
        if len(at):
            ok = (np.add.reduceat(times, at) >= need[at]) & (np.maximum.reduceat(early, at) > 0)
            out.append(np.stack([np.full(int(ok.sum()), a[lo]), b[at[ok]]], 1))
    p = np.concatenate(out)
    return pa.table({"a": p[:, 0], "b": p[:, 1]})


def _apart(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """On how many bits the bitmaps of each left and right document differ; larger ones are folded to the smaller size.

    This is at most the number of grams that only one of them has."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)

    def by_size(some: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        size = np.array([len(x) for x in some])
        return {int(s): (np.flatnonzero(size == s), np.frombuffer(b"".join(x for x in some if len(x) == s), np.uint64).reshape(-1, s // 8)) for s in np.unique(size)}

    def folded(x: np.ndarray, width: int) -> np.ndarray:
        while x.shape[1] > width:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        return x

    rights = by_size(right)
    for i, x in by_size(left).values():
        for j, y in rights.values():
            width = min(x.shape[1], y.shape[1])
            a, b = folded(x, width), folded(y, width)
            for k, one in zip(i, a, strict=True):
                out[k, j] = np.bitwise_count(b ^ one).sum(1)
    return out


def _bitmap_blocks(t: pa.Table) -> Iterator[tuple]:
    """Each block's name and its left and right documents: ids, set sizes, bitmaps and labels (their ids without any)."""
    t = t.sort_by([("block", "ascending"), ("side", "ascending"), ("doc", "ascending")])
    name, side, doc, n = (t.column(k).to_numpy() for k in ("block", "side", "doc", "n"))
    label = t.column("label").to_numpy() if "label" in t.column_names else doc
    sketch = t.column("sketch").to_pylist()
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, int)
    for a, b in zip(first, [*first[1:], len(name)], strict=True):
        sides = []
        for s in (0, 1):
            at = a + np.flatnonzero(side[a:b] == s)
            at = at[np.concatenate([[True], doc[at][1:] != doc[at][:-1]])] if len(at) else at
            sides.append((doc[at], n[at], [sketch[k] for k in at], label[at]))
        yield name[a], *sides


def _may_link(left: tuple, right: tuple, percent: int) -> np.ndarray:
    (ld, ln, lg, ll), (rd, rn, rg, rl) = left, right
    if not len(ld) or not len(rd):
        return np.zeros((len(ld), len(rd)), dtype=bool)
    return (_apart(lg, rg) * (100 + percent) <= (100 - percent) * (ln[:, None] + rn[None, :])) & (ll[:, None] != rl[None, :])


def _likely(percent: int):
    """The pairs of a document and its candidates that their bitmaps allow."""

    def keep(key: tuple, t: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, left, right in _bitmap_blocks(t):
            i, j = np.nonzero(_may_link(left, right, percent))
            a.append(left[0][i])
            b.append(right[0][j])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return keep


def _runs(n: np.ndarray) -> np.ndarray:
    """Which of several smaller blocks each document belongs to, by their number and their grams."""
    return np.maximum(np.arange(len(n)) // (BLOCK // 2), (np.cumsum(n) // (GRAMS // 2)))


def _nearest(percent: int):
    """(a, b) of each left document of a block and the two nearest ones that its bitmap allows, of other components."""

    def keep(key: tuple, t: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, left, right in _bitmap_blocks(t):
            for at in np.array_split(np.arange(len(left[0])), len(left[0]) // 512 + 1):
                some = (left[0][at], left[1][at], [left[2][k] for k in at], left[3][at])
                ok = _may_link(some, right, percent)
                if not ok.any():
                    continue
                far = np.where(ok, _apart(some[2], right[2]), np.iinfo(np.int64).max)
                for _ in range(2):
                    j = far.argmin(1)
                    i = np.flatnonzero(far[np.arange(len(far)), j] < np.iinfo(np.int64).max)
                    a.append(some[0][i])
                    b.append(right[0][j[i]])
                    far[i, j[i]] = np.iinfo(np.int64).max
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return keep


def _requests(percent: int):
    """(block, doc) of the documents of a block of bitmaps that have a partner there, in blocks small enough to count."""

    def keep(key: tuple, t: pa.Table) -> pa.Table:
        rows: list[tuple[str, np.ndarray]] = []
        for name, left, right in _bitmap_blocks(t):
            ok = _may_link(left, right, percent)
            i, j = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
            li, rj = _runs(left[1][i]), _runs(right[1][j])
            for u in np.unique(li):
                for v in np.unique(rj):
                    some = ok[np.ix_(i[li == u], j[rj == v])]
                    if some.any():
                        rows.append((f"{name}/{u}/{v}", np.union1d(left[0][i[li == u][some.any(1)]], right[0][j[rj == v][some.any(0)]])))
        return pa.table({"block": pa.array([x for x, d in rows for _ in d], pa.string()), "doc_id": pa.array(np.concatenate([np.zeros(0, np.int64), *[d for _, d in rows]]))})

    return keep


def _fragment_counts(grams: np.ndarray, who: np.ndarray, m: int) -> np.ndarray:
    """Common grams of each two of m documents in one fragment. Grams that the same documents have count together."""
    out = np.zeros((m, m))
    by = np.argsort(grams, kind="stable")
    g, w = grams[by], who[by]
    new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    size = np.diff(np.append(np.flatnonzero(new), len(g)))
    column = np.cumsum(new) - 1
    shared = size[column] > 1 if len(g) else new
    column, w = column[shared], w[shared]
    if not len(w):
        return out
    # a gram's documents as one hash
    edge = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    pattern = np.add.reduceat(mix64(w.astype(np.uint64) + np.uint64(12345)), edge)
    _, one, times = np.unique(pattern, return_index=True, return_counts=True)
    ends = np.append(edge[1:], len(w))
    for at in range(0, len(one), 4096):
        some = one[at : at + 4096]
        x = np.zeros((m, len(some)))
        lengths = ends[some] - edge[some]
        rows = w[np.repeat(edge[some] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())]
        x[rows, np.repeat(np.arange(len(some)), lengths)] = 1
        out += (x * times[at : at + 4096]) @ x.T
    return out


def _forest(percent: int):
    """A spanning forest (a, b) of the links of each block, counted fragment by fragment."""

    def link(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("block", "ascending"), ("doc", "ascending"), ("fragment", "ascending")])
        name, doc, n, fragment = (t.column(k).to_numpy() for k in ("block", "doc", "n", "fragment"))
        grams = t.column("grams").to_pylist()
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, int)
        a, b = [], []
        for lo, hi in zip(first, [*first[1:], len(name)], strict=True):
            ids, who = np.unique(doc[lo:hi], return_inverse=True)
            sizes = np.zeros(len(ids), dtype=np.int64)
            sizes[who] = n[lo:hi]
            total = np.zeros((len(ids), len(ids)))
            for k in range(len(CUTS) + 2):
                at = np.flatnonzero(fragment[lo:hi] == k)
                at = at[np.unique(who[at], return_index=True)[1]]
                parts = [np.frombuffer(grams[lo + i], np.uint64) for i in at]
                if parts:
                    total += _fragment_counts(np.concatenate(parts), np.repeat(who[at], [len(x) for x in parts]), len(ids))
            common = np.rint(total).astype(np.int64)
            linked = (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)) & (common > 0)
            left = np.ones(len(ids), dtype=bool)
            for root in range(len(ids)):
                if left[root]:
                    left[root], front = False, np.array([root])
                    while len(front):
                        front = np.flatnonzero(linked[front].any(0) & left)
                        left[front] = False
                        a += [int(ids[root])] * len(front)
                        b += ids[front].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def _wanted(docs: DataFrame, wanted: DataFrame, order, n: int, f, schema: str) -> DataFrame:
    """f(doc, grams, blocks) -> rows of the schema, for each document of wanted(doc_id, digest, blocks)."""
    kinds = [pa.field(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in schema.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                rows: list[tuple] = []
                for doc, t, digest, blocks in zip(b.column(0).to_pylist(), _texts(b, 1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    h = gram_hashes(t, n)
                    if hashlib.blake2b(h.tobytes(), digest_size=16).digest() == digest:  # else another row with this id
                        rows += f(doc, h, blocks, order.value)
                cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(cols, kinds, strict=True)], names=[k.name for k in kinds])

    return docs.join(sized(cut(wanted, "wanted")), "doc_id").select("doc_id", "text", "digest", "blocks").mapInArrow(freeing(make), schema)


def _segments(doc: int, h: np.ndarray, blocks: list[str], order: Order) -> list[tuple]:
    """A document's grams, cut by fragment of the global order, for each of its blocks."""
    ordered, rare = order.sort(h)
    limits = np.searchsorted(ordered[:rare], np.array(CUTS, dtype=np.uint64))
    parts = [np.sort(x).tobytes() for x in np.split(ordered, [*limits.tolist(), rare])]
    return [(block, doc, len(h), k, part) for block in blocks for k, part in enumerate(parts) if part]


def _fine(doc: int, h: np.ndarray, blocks: list[str], order: Order) -> list[tuple]:
    return [(doc, len(h), _sketch(h, 16))]


def _counted(docs: DataFrame, wanted: DataFrame, order, n: int, percent: int) -> DataFrame:
    """Links among the documents of each block of wanted(doc_id, digest, n, block): their grams meet there.

    A large block is a group of its own, small ones are dealt to groups of about as many grams."""
    total = wanted.agg(F.sum("n")).first()[0] or 0
    sizes = wanted.groupBy("block").agg(F.sum("n").alias("grams"))
    own = F.when(F.col("grams") * 8 > GRAMS, F.col("block")).otherwise(F.pmod(F.xxhash64("block"), F.lit(max(12, total // (GRAMS // 2)))).cast("string"))
    named = wanted.join(sizes.withColumn("own", F.concat_ws("|", own, "block")), "block")
    blocks = named.groupBy("doc_id", "digest").agg(F.collect_set("own").alias("blocks"))
    parts = _wanted(docs, blocks, order, n, _segments, "block string, doc long, n long, fragment int, grams binary")
    return parts.withColumn("bucket", F.substring_index("block", "|", 1)).groupBy("bucket").applyInArrow(freeing(_forest(percent)), "a long, b long")


def _by_leader(pairs: DataFrame) -> DataFrame:
    """Blocks of a document with its partners, at most about BLOCK of them in each."""
    blocks = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / BLOCK).alias("k"))
    right = pairs.join(blocks, "a").select("a", F.concat_ws("/", F.col("a"), F.pmod(F.xxhash64("b"), F.col("k"))).alias("block"), "b")
    return right.select("block", F.lit(1).alias("side"), F.col("b").alias("doc")).unionByName(right.select("block", F.lit(0).alias("side"), F.col("a").alias("doc")).distinct())


def _dealt(requests: DataFrame, sets: DataFrame, per_bucket: int) -> DataFrame:
    """The bitmaps that each block needs, blocks dealt to buckets."""
    requests = cut(requests, "requests")
    buckets = max(12, requests.count() // per_bucket)
    return requests.join(sets.select("doc", "n", "sketch").hint("merge"), "doc").withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)))


def _first_blocks(clusters: DataFrame) -> DataFrame:
    """doc, digest, cluster, n, whole and block: a small cluster is one block; a large one several, each with its leaders."""
    leaders = [F.min_by("doc", F.xxhash64(F.lit(k), "doc")) for k in range(LEADERS)]
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / GRAMS)).cast("int")
    per = clusters.groupBy("cluster").agg(parts.alias("parts"), F.array_distinct(F.array(*leaders)).alias("leaders"))
    own = F.array(F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    blocks = F.when(F.array_contains("leaders", F.col("doc")), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)
    rows = clusters.join(per, "cluster").withColumn("part", F.explode(blocks))
    return rows.select("doc", "digest", "cluster", "n", (F.col("parts") == 1).alias("whole"), F.concat_ws("/", F.lit("c"), "cluster", "part").alias("block"))


def _open_blocks(placed: DataFrame) -> DataFrame:
    """Blocks of bitmaps (block, side, doc, label): a cluster's members outside its main component, and all its members."""
    main = placed.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("main"), F.sum("n").alias("r"), (F.sum("n") - F.max("n")).alias("l"))
    main = main.filter("l > 0").select("cluster", "main", F.ceil(F.col("l") / SCREENED).cast("int").alias("l"), F.ceil(F.col("r") / SCREENED).cast("int").alias("r"))
    rows = placed.join(main, "cluster")

    def named(side: int, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.lit(side), "doc"), F.col(own))
        name = lambda k: F.concat_ws("/", F.lit("o"), "cluster", *((mine, k) if side == 0 else (k, mine)))
        some = rows.filter("label <> main") if side == 0 else rows
        return some.select(F.explode(F.transform(F.sequence(F.lit(0), F.col(other) - 1), name)).alias("block"), F.lit(side).alias("side"), "doc", "label")

    return named(0, "l", "r").unionByName(named(1, "r", "l"))


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", members_per_bucket: int = 1_000_000) -> DataFrame:
    """doc_id, n_grams (distinct) and component_id (smallest id reachable over links) of every row of docs.

    Two documents link when 100 * common >= percent * all distinct grams. Null, empty and blank texts have no grams and
    no links. A null id has no component. Rows that repeat an id are one document; if their texts differ, the links of
    the one with the smallest digest stand for it. An empty table gives an empty result; only id and text are read.
    A task gets about members_per_bucket prefix grams, 40 bytes each, a large block up to GRAMS grams, 8 bytes each.
    """
    spark = docs.sparkSession
    docs = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    order = spark.sparkContext.broadcast(_order(docs, n))  # COUNTERS sums and LEVELS levels at most
    table = cut(_prefixes(docs, order, n, percent), "prefixes")
    firsts = cut(table.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    chosen = firsts.groupBy("rep").agg(F.min("digest").alias("digest")).withColumnRenamed("rep", "doc_id")
    reps = table.join(chosen.hint("merge"), ["doc_id", "digest"], "left_semi")
    total = table.agg(F.sum(F.length("prefix") / 6)).first()[0] or 0
    buckets = max(1, int(-(-total // members_per_bucket))) * 3
    found = cut(_deal(reps, order, buckets).groupBy("bucket").applyInArrow(freeing(_candidates(percent, order)), "kind int, a long, docs array<long>, times array<long>, early array<long>, need array<long>"), "candidates")
    listed = found.filter("kind = 0").withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(buckets)))
    pairs = cut(listed.groupBy("bucket").applyInArrow(freeing(_paired), "a long, b long"), "pairs")
    sets = table.filter("digest is not null and doc_id is not null").select(F.col("doc_id").alias("doc"), "digest", F.col("n_grams").alias("n"), "sketch").join(chosen.withColumnRenamed("doc_id", "doc").hint("merge"), ["doc", "digest"], "left_semi").dropDuplicates(["doc"])
    sets = cut(sets, "sets")
    likely = cut(_dealt(_by_leader(pairs), sets, 5000).groupBy("bucket").applyInArrow(freeing(_likely(percent)), "a long, b long").filter("a <> b").distinct(), "likely")

    # a large group's gram stands for a node of its own: if it is some document's id, two clusters become one
    grouped = found.filter("kind = 1").select((-F.col("a") - 1).alias("a"), F.explode("docs").alias("b"))
    clusters = components(likely.unionByName(grouped)).select(F.col("node").alias("doc"), F.col("label").alias("cluster"))
    clusters = cut(clusters.join(sets.select("doc", "digest", "n").hint("merge"), "doc"), "clusters")
    blocks = cut(_first_blocks(clusters), "blocks")
    links = cut(_counted(docs, blocks.select(F.col("doc").alias("doc_id"), "digest", "n", "block"), order, n, percent), "links")

    large = blocks.filter("not whole").select("doc", "digest", "n", "cluster").distinct()
    if large.limit(1).count():
        fine = cut(_wanted(docs, large.select(F.col("doc").alias("doc_id"), "digest", F.array(F.lit("")).alias("blocks")), order, n, _fine, "doc long, n long, sketch binary"), "fine")
        members = large.select(F.col("doc").alias("doc_id"), "digest", "n")

        def open_blocks(links: DataFrame) -> DataFrame:
            known = components(links).withColumnRenamed("node", "doc")
            placed = cut(large.join(known, "doc", "left").select("doc", "cluster", F.coalesce("label", "doc").alias("label")), "placed")
            return _dealt(_open_blocks(placed), fine, 2 * SCREENED)

        if clusters.groupBy("cluster").count().filter(F.col("count") > SCREENED).limit(1).count():  # several blocks of bitmaps: their nearest first
            near = cut(open_blocks(links).groupBy("bucket").applyInArrow(freeing(_nearest(percent)), "a long, b long").filter("a <> b").distinct(), "nearest")
            asked = _by_leader(near).select(F.col("doc").alias("doc_id"), "block").join(members, "doc_id")
            links = cut(links.unionByName(_counted(docs, asked, order, n, percent)), "links")
        asked = cut(open_blocks(links).groupBy("bucket").applyInArrow(freeing(_requests(percent)), "block string, doc_id long"), "asked").join(members, "doc_id")
        links = cut(links.unionByName(_counted(docs, asked, order, n, percent)), "links")

    labels = components(links).select(F.col("node").alias("rep"), "label")
    per = firsts.join(labels, "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"))
    out = table.select("doc_id", "n_grams", "digest").join(per, "digest", "left")
    return out.select("doc_id", "n_grams", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
