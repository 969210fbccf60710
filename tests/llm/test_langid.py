from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import pytest

from rulelake.llm import langid


def segmentations(word, vocab):
    for k in range(len(word)):
        for cuts in combinations(range(1, len(word)), k):
            parts = [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)), strict=True)]
            if all(p in vocab or len(p) == 1 for p in parts):
                yield [vocab.get(p, 0) for p in parts]


def small():
    vocab = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "▁", "▁a", "bab", "▁ab"], 1)}
    p = np.random.default_rng(0).random((len(vocab) + 1, 2))
    return vocab, np.vstack([p / p.sum(0), np.zeros(2)])


def test_forward_sums_all_segmentations():
    vocab, p = small()
    words = ["▁abab", "▁b", "▁axb", "▁babab"]
    got = langid.forward(words, vocab, p)
    for w, g in zip(words, got, strict=True):
        assert np.allclose(np.exp(g), sum(np.prod(p[s], axis=0) for s in segmentations(w, vocab)))


def test_expected_uses():
    vocab, p = small()
    got = langid.expected(["▁abab", "▁axb"], np.array([2.0, 1.0]), vocab, p[:, 0])
    want = np.zeros(len(p))
    for w, n in (("▁abab", 2), ("▁axb", 1)):
        all_ = list(segmentations(w, vocab))
        total = sum(np.prod(p[s, 0]) for s in all_)
        for s in all_:
            for i in s:
                want[i] += n * np.prod(p[s, 0]) / total
    assert np.allclose(got, want)


def test_documents(documents):
    rows = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd(odd, none):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = next(x.text for x in odd.collect() if x.doc_id == r.doc_id)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    assert langid.identify(none).collect() == []


def test_without_languages(documents):
    rows = langid.identify(documents.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_more_words_than_are_remembered(documents, monkeypatch):
    monkeypatch.setattr(langid, "REMEMBERED", 50)
    vocab = langid.vocabulary(langid.default_vocabulary())
    p = np.random.default_rng(0).random((len(vocab) + 1, 2))
    model = langid.Model(["a", "b"], langid.default_vocabulary(), np.vstack([p / p.sum(0), np.zeros(2)]), np.array([0.5, 0.5]))
    texts = [r.text for r in documents.limit(8).collect()]
    some = langid.score(texts, model)
    monkeypatch.setattr(langid, "REMEMBERED", 100_000)
    langid._known.clear()
    whole = langid.score(texts, model)
    langid._known.clear()
    assert some[0] == whole[0] and np.allclose(some[1], whole[1])


@pytest.mark.parametrize("text", ["½ ²", "Ⅷ ①", "١٢٣", "12_3", "⅓x⅓"])
def test_numerals_are_no_letters(text):
    assert langid.stretches(text) == (["▁x"] if "x" in text else [])
