"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on one binned feature (or on a pair) are boosted in turn, each correcting what the others leave. All trees
on a feature add up to one lookup table, so that a score is a sum of table entries by bin.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fold, freeing

FEATURES = ("log_words", "word_length", "symbols", "exclamations", "upper", "digits", "commas", "distinct", "top_word", "repeats_next", "repeated_lines", "line_words", "non_ascii", "longest_word")
_SYMBOLS = {c: None for c in map(ord, "#*$%&|<>{}[]\\^~=+@_`")}
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def features(text: str | None) -> list[float]:
    """Shares and means over the whole text; all 0 for a text without words."""
    text = text or ""
    w = _WORDS.findall(text)
    n, size = len(w), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(w)
    lines = [x for x in text.split("\n") if x]
    letters = sum(map(len, w))
    upper = sum(map(str.isupper, w))
    return [
        float(np.log1p(n)), letters / n, (size - len(text.translate(_SYMBOLS))) / n, text.count("!") / n, upper / n,
        sum(map(text.count, "0123456789")) / size, text.count(",") / n, len(counts) / n, max(counts.values()) / n, sum(map(str.__eq__, w, w[1:])) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0, n / max(1, len(lines)), 1 - len(text.encode("ascii", "ignore")) / size, float(max(map(len, w))),
    ]


def _bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, x, side="right")


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float = 1.0) -> np.ndarray:
    """Values by bin of the best tree on gradient and weight sums, split greedily."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + l2)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                m = np.arange(a + 1, b)
                s = gain(a, m) + gain(m, b) - gain(a, b)
                s[(H[m] - H[a] < 0.5) | (H[b] - H[m] < 0.5)] = 0
                if (i := int(s.argmax())) >= 0 and s[i] > best:
                    best, at = s[i], (k, int(m[i]))
        if at is None:
            break
        a, b = parts.pop(at[0])
        parts += [(a, at[1]), (at[1], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + l2)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree on a grid with one split of each side, and its gain."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(g)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            quads = [(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))]
            gs = np.array([G[i, j], G[i, -1] - G[i, j], G[-1, j] - G[i, j], G[-1, -1] - G[i, -1] - G[-1, j] + G[i, j]])
            hs = np.array([H[i, j], H[i, -1] - H[i, j], H[-1, j] - H[i, j], H[-1, -1] - H[i, -1] - H[-1, j] + H[i, j]])
            if (gain := float((gs**2 / (hs + 1)).sum())) > best:
                best = gain
                for q, v in zip(quads, gs / (hs + 1), strict=True):
                    out[q] = v
    return best, out


@dataclass
class Model:
    """Lookup tables: one per feature over its bins, one per pair over coarser ones."""

    base: float
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            f += t[_bins(x[:, j], self.edges[j])]
        c = {j: _bins(x[:, j], self.coarse[j]) for ij in self.pairs for j in ij}
        for (i, j), t in self.pairs.items():
            f += t[c[i], c[j]]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, bins: int = 32, coarse: int = 8, pairs: int = 8) -> Model:
    """Boost main effects in turn, then the pairs that explain most of what is left. Without rows, all scores are 0.5."""
    k = x.shape[1]
    quantiles = lambda n: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(k)]
    edges, grid = quantiles(bins), quantiles(coarse)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(base, edges, grid, tables, {})
    if not len(x):
        return model
    b, c = [_bins(x[:, j], edges[j]) for j in range(k)], [_bins(x[:, j], grid[j]) for j in range(k)]
    f = np.full(len(x), base)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            g, h = residual()
            t = rate * _tree(np.bincount(b[j], g, len(tables[j])), np.bincount(b[j], h, len(tables[j])), 3)
            tables[j] += t
            f += t[b[j]]

    def cells(i: int, j: int) -> tuple[float, np.ndarray]:
        g, h = residual()
        shape = (len(grid[i]) + 1, len(grid[j]) + 1)
        at = c[i] * shape[1] + c[j]
        n = shape[0] * shape[1]
        return _pair_tree(np.bincount(at, g, n).reshape(shape), np.bincount(at, h, n).reshape(shape))

    chosen = sorted(combinations(range(k), 2), key=lambda ij: -cells(*ij)[0])[:pairs]
    model.pairs = {ij: np.zeros((len(grid[ij[0]]) + 1, len(grid[ij[1]]) + 1)) for ij in chosen}
    for _ in range(rounds // 4):
        for (i, j), t in model.pairs.items():
            add = rate * cells(i, j)[1]
            t += add
            f += add[c[i], c[j]]
    return model


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its features, one pass over the whole texts."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                rows = [features(x.as_py()) for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(freeing(compute), "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most most_rows labelled rows outside the held-out fifth: those with the smallest hashes of their ids.

    Only their texts are read for it. A label that is given twice counts once; of rows that repeat an id, the smallest text."""
    known = labels.filter(col(label).isNotNull()).select(F.col("doc_id"), col(label).cast("double").alias("y")).filter(fold(F.col("doc_id"), 5) != 0)
    some = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_rows)
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).join(F.broadcast(some.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = feature_table(texts).join(F.broadcast(some), "doc_id").select("doc_id", "x", "y").collect()  # at most most_rows
    rows.sort(key=lambda r: (r["doc_id"], r["y"]))
    return fit(np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows], dtype=float))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    Null, empty and blank texts have features of 0 and the score that those get. A null id is never held out. Rows that
    repeat an id are scored each for itself; labels that repeat one count each. Without labels every score is 0.5.
    Only id and text of docs are read.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                b = whole.slice(first, 1000)
                s = model.score(np.array([features(t.as_py()) for t in b.column(1)], dtype=float).reshape(-1, len(FEATURES)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(freeing(score), "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; they are scored where they are read.

    Null, empty and blank texts have the score that features of 0 get. Each of rows that repeat an id stays or goes for
    itself, and so do rows without an id. Without labels all stay, as every score is 0.5. An empty table gives an empty one;
    columns of any name stay as they are."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                b = whole.slice(first, 1000)
                x = np.array([features(t.as_py()) for t in b.column(at)], dtype=float).reshape(-1, len(FEATURES))
                yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(freeing(keep), docs.schema)
