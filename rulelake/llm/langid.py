"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces, by the forward algorithm; training finds the piece probabilities by expectation and
maximisation over the same lattice. A text's score is that of its words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, fold

UNKNOWN = "und"
#: Longest piece and longest stretch of a word that is segmented as one.
PIECE, STRETCH = 12, 24
#: Scores that a Python worker keeps: words times languages, and words at most.
SCORES, REMEMBERED = 32_000_000, 1_000_000
_WORDS = re.compile(r"[^\W\d_]+")
#: Index 0 stands for a character that the vocabulary lacks.
_FLOOR = 1e-9


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(4)
def vocabulary(path: str) -> dict[str, int]:
    """Pieces in lower case with letters only, by index from 1; a leading mark stands for the start of a word."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = dict.fromkeys(p.lower() for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for p in [sp.id_to_piece(i)])
    return {p: i for i, p in enumerate((p for p in pieces if len(p) <= PIECE and (p.strip("▁") + "a").isalpha() and p != ""), 1)}


def stretches(text: str) -> list[str]:
    """Words of letters in lower case after the mark of a word start, cut after every STRETCH characters. What isalpha
    denies, numerals of any script among it, is no letter and ends a word."""
    out, found = [], _WORDS.findall(text.lower())
    if not "".join(found).isalpha():
        found = [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]
    for w in found:
        w = "▁" + w
        if len(w) <= STRETCH:
            out.append(w)
        else:
            out += [w[i : i + STRETCH] for i in range(0, len(w), STRETCH)]
    return out


def lattice(words: list[str], vocab: dict[str, int]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, words that have a piece there, its index) of words of equal length; arcs in order of their ends."""
    out, n, get = [], len(words[0]), vocab.get
    for j in range(1, n + 1):
        for i in range(max(0, j - PIECE), j):
            one = 0 if j - i == 1 else -1
            idx = np.array([get(w[i:j], one) for w in words], dtype=np.int32)
            at = np.flatnonzero(idx >= 0)
            if len(at):
                out.append((i, j, at, idx[at]))
    return out


def forward(words: list[str], vocab: dict[str, int], p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, summed over all segmentations. p: pieces (and -1, zeros) by languages."""
    out = np.empty((len(words), p.shape[1]))
    by_length = defaultdict(list)
    for k, w in enumerate(words):
        by_length[len(w)].append(k)
    for n, ks in by_length.items():
        for at in range(0, len(ks), 5000):
            some = ks[at : at + 5000]
            alpha = np.zeros((n + 1, len(some), p.shape[1]))
            alpha[0] = 1
            for i, j, at_words, idx in lattice([words[k] for k in some], vocab):
                alpha[j, at_words] += alpha[i, at_words] * p[idx]
            out[some] = np.log(alpha[n])
    return out


def expected(words: list[str], counts: np.ndarray, vocab: dict[str, int], p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words, one language. p: probabilities by piece, with a last 0."""
    total = np.zeros(len(p))
    by_length = defaultdict(list)
    for k, w in enumerate(words):
        by_length[len(w)].append(k)
    for n, ks in by_length.items():
        for at in range(0, len(ks), 5000):
            some = ks[at : at + 5000]
            arcs = lattice([words[k] for k in some], vocab)
            a, b = np.zeros((n + 1, len(some))), np.zeros((n + 1, len(some)))
            a[0], b[n] = 1, 1
            for i, j, w, idx in arcs:
                a[j, w] += a[i, w] * p[idx]
            for i, j, w, idx in sorted(arcs, key=lambda x: -x[0]):
                b[i, w] += b[j, w] * p[idx]
            scale = counts[some] / a[n]
            for i, j, w, idx in arcs:
                np.add.at(total, idx, a[i, w] * p[idx] * b[j, w] * scale[w])
    return total


class Model:
    """Piece probabilities by language, and a prior."""

    def __init__(self, languages: list[str], path: str, p: np.ndarray, prior: np.ndarray):
        self.languages, self.path, self.p, self.prior = languages, path, p, prior
        self.key = hash((path, tuple(languages), p.tobytes()[:4096], float(p.sum())))


_known: dict[int, tuple[dict[str, int], np.ndarray]] = {}


def score(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each whole text and its posterior probability; und and 0 for texts without letters."""
    vocab, n = vocabulary(model.path), len(model.languages)
    if model.key not in _known:
        _known.clear()
        _known[model.key] = ({}, np.zeros((max(1, min(REMEMBERED, SCORES // max(1, n))), n), dtype=np.float32))
    index, values = _known[model.key]
    most = len(values)
    parts = [stretches(t or "") for t in texts]
    if len(index) == most:
        index.clear()
    new = list({w for p in parts for w in p if w not in index})
    extra = {}
    if new:
        room = most - len(index)
        logs = forward(new, vocab, model.p)
        start = len(index)
        values[start : start + min(room, len(new))] = logs[:room]
        index.update(zip(new[:room], range(start, start + room)))  # noqa: B905
        extra = dict(zip(new[room:], logs[room:], strict=True))
    total = np.tile(np.log(model.prior), (len(texts), 1))
    for k, p in enumerate(parts):
        if extra:
            for w in p:
                total[k] += values[index[w]] if w in index else extra[w]
        elif p:
            total[k] += values[np.fromiter(map(index.__getitem__, p), dtype=np.int64, count=len(p))].sum(0, dtype=np.float64)
    post = np.exp(total - total.max(1, keepdims=True)) if n else np.zeros((len(texts), 0))
    post /= post.sum(1, keepdims=True) if n else 1
    empty = np.array([not p or not n for p in parts], dtype=bool)
    best = post.argmax(1) if n else np.zeros(len(texts), dtype=int)
    return [UNKNOWN if e else model.languages[k] for e, k in zip(empty, best, strict=True)], np.where(empty, 0.0, post.max(1, initial=0))


def train(docs: DataFrame, path: str, id_col: str, text_col: str, lang_col: str, most_docs: int, rounds: int, most_languages: int) -> Model:
    """Piece probabilities from labelled documents outside the held-out quarter, by expectation and maximisation.

    At most most_docs documents of each language are used, those with the smallest hashes of their ids in expectation:
    a hash threshold is set from the language's count. Each job sums over whole texts on the executors; what reaches the
    driver is one number for each piece and language."""
    known = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), col(lang_col).alias("lang")).filter("lang is not null").filter(F.coalesce(fold(F.col("doc_id"), 4), F.lit(2)) != 2)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages: the model would have as many probabilities for each piece")
    languages = sorted(counts)
    vocab = vocabulary(path)
    if not languages:
        return Model([], path, np.zeros((len(vocab) + 2, 0)), np.zeros(0))
    scale = 1 << 20
    keep = F.lit(False)
    for lang, n in counts.items():
        keep |= (F.col("lang") == lang) & (F.pmod(F.xxhash64(F.lit(41), "doc_id"), F.lit(scale)) < max(1, int(scale * min(1.0, most_docs / n))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = defaultdict(Counter)
        for b in batches:
            for t, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                by[lang].update(stretches(t.as_py() or ""))
            rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
            by.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["lang", "word", "n"])

    words = cut(known.filter(keep).select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    p = np.full((len(vocab) + 1, len(languages)), 1.0)
    # longer pieces start likelier than their letters, or none would be used
    for piece, i in vocab.items():
        p[i] = 4.0 ** len(piece.strip("▁"))
    p /= p.sum(0)
    for _ in range(rounds):
        now = p

        def step(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            vocab = vocabulary(path)
            total = np.zeros((len(now) + 1, len(languages)))
            for b in batches:
                lang, word, n = np.array(b.column(0).to_pylist(), dtype=object), b.column(1).to_pylist(), b.column(2).to_numpy()
                for k, one in enumerate(languages):
                    at = np.flatnonzero(lang == one)
                    if len(at):
                        total[:, k] += expected([word[i] for i in at], n[at].astype(float), vocab, np.append(now[:, k], 0.0))
            i, k = np.nonzero(total[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[:-1][i, k])], names=["i", "k", "n"])

        got = words.mapInArrow(step, "i int, k int, n double").groupBy("i", "k").agg(F.sum("n").alias("n")).collect()
        c = np.full((len(vocab) + 1, len(languages)), 0.01)
        for r in got:
            c[r["i"], r["k"]] += r["n"]
        p = np.maximum(c / c.sum(0), _FLOOR)
    p = np.vstack([p, np.zeros((1, len(languages)))])  # index -1: no piece
    prior = np.array([counts[x] for x in languages], dtype=float)
    return Model(languages, path, p, prior / prior.sum())


def identify(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = 2000, rounds: int = 4, most_languages: int = 1000) -> DataFrame:
    """doc_id, held_out, lang_pred and score (posterior) of every row of docs.

    `und` with score 0 where the text is null or has no letter, and everywhere if no document has a language. A null id
    is held out of training. Rows that repeat an id are scored each for itself. Of docs, only id, text and (to learn) language are read.
    Every language is learned; more than most_languages are an error, as the driver and each worker hold a probability for
    each piece in each. Words are segmented in stretches of 24 characters, by pieces of at most 12.
    """
    path = path or default_vocabulary()
    model = docs.sparkSession.sparkContext.broadcast(train(docs, path, id_col, text_col, lang_col, most_docs, rounds, most_languages))  # vocabulary times languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                lang, s = score(b.column(1).to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(s)], names=["doc_id", "lang_pred", "score"])

    out = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
