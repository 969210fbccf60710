from collections import Counter

import corpus_pipeline as P
import pytest
from test_exact_dedup import exact_dedup  # noqa: F401
from test_mixing import targets
from test_ngram_join import brute

from rulelake.llm import packing, quality_gam


def stage(k):
    return P.STAGES[k][1]


@pytest.fixture(scope="module")
def repeated(odd):
    return odd


@pytest.mark.parametrize("k", range(4))
def test_columns_stay(spark, sf, documents, repeated, none, k):
    for docs in (documents, repeated, none.select(repeated.columns)):
        out = stage(k)(spark, docs, sf)
        assert out.columns == docs.columns
        assert out.count() <= 3 * docs.count()


def test_quality(spark, sf, documents):
    scores = quality_gam.classify(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id for r in scores.collect() if r.predicted}
    assert {r.doc_id for r in stage(0)(spark, documents, sf).collect()} == want


def test_exact(spark, sf, documents, repeated):
    for docs in (documents, repeated):
        best = {}
        for r in docs.collect():
            key = (r.text or "").translate({c: None for c in (32, *range(9, 14))})
            rank = (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
            if key not in best or rank < best[key][0]:
                best[key] = (rank, r.doc_id)
        got = stage(1)(spark, docs, sf).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(v[1]) for v in best.values())


def test_near(spark, sf, documents):
    want = {i for i, (_, c) in brute({r.doc_id: r.text for r in documents.collect()}, 80, 5).items() if i == c}
    assert {r.doc_id for r in stage(2)(spark, documents, sf).collect()} == want


def test_mix(spark, sf, documents):
    got = Counter(r.doc_id for r in stage(3)(spark, documents, sf).collect())
    rows = {r.doc_id: (r.source, len((r.text or "").split())) for r in documents.collect()}
    sizes, taken = Counter(), Counter()
    for i, (s, n) in rows.items():
        sizes[s] += n
        taken[s] += n * got[i]
    assert max(got.values()) <= 3
    for s, t in targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= max(n for x, n in rows.values() if x == s) / 2 + 1


def test_run(spark, sf, documents):
    rows = P.run(spark, sf).collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in documents.collect()}
    per = Counter(r.sequence_id for r in rows for _ in range(r.length))
    assert rows and max(per.values()) <= packing.ROOM


def test_near_takes_five_words(spark, sf):
    from test_ngram_join import grams

    base = [f"w{k}" for k in range(200)]
    texts = {1: " ".join(base), 2: "other words that are not in the first", 3: None}
    for i, edits in enumerate(((40, 80, 120, 160), (30, 60, 90, 120, 150), (20, 21, 22), (10,)), 4):
        texts[i] = " ".join(f"x{i}" if k in edits else w for k, w in enumerate(base))
    sets, up = {i: grams(t, 5) for i, t in texts.items()}, {i: i for i in texts}
    for _ in texts:  # the smallest label spreads
        for a in texts:
            up[a] = min(up[b] for b in texts if a == b or sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert up[4] == 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in stage(2)(spark, docs, sf).collect()} == {i for i in texts if up[i] == i}
