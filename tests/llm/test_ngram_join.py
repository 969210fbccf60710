import re
from collections import Counter

import numpy as np
import pytest

from rulelake.llm import ngram_join
from rulelake.llm.components import components

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(texts, percent=85, n=4):
    """Component by id over all pairs; equal ids are one document."""
    ids, sets, up = list(texts), {i: grams(t, n) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def hold(docs):
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    want = brute(texts)
    rows = ngram_join.jaccard_components(docs, members_per_bucket=3000).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_grams, r.component_id) == want[r.doc_id], r
        else:
            assert r.component_id is None


def test_documents(documents):
    hold(documents)


def test_odd(odd):
    hold(odd)


def test_empty(none):
    assert ngram_join.jaccard_components(none).collect() == []


@pytest.mark.parametrize("edits", [2, 5])
def test_large_groups_of_near_copies(spark, edits):
    """Links at the threshold among many variants of one text, and documents that share only a passage."""
    rng = np.random.default_rng(edits)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, len(w), rng.integers(0, edits + 1)):
            w[k] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    for i in range(150, 300):
        rows.append((i, " ".join([*base[:30], *(f"y{i}_{k}" for k in range(rng.integers(0, 60)))])))
    rows += [(400 + i, " ".join(base[:30])) for i in range(40)]
    hold(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


@pytest.mark.parametrize("edits", [2, 5])
def test_large_clusters_meet_in_several_blocks(spark, edits, monkeypatch):
    """Clusters of several blocks, and grams whose members are dealt to several tasks."""
    for name, value in (("BLOCK", 20), ("SCREENED", 16), ("HOT", 10)):
        monkeypatch.setattr(ngram_join, name, value)
    test_large_groups_of_near_copies.__wrapped__(spark, edits) if hasattr(test_large_groups_of_near_copies, "__wrapped__") else test_large_groups_of_near_copies(spark, edits)


@pytest.mark.parametrize("edits", [2, 5])
def test_grams_that_the_sketch_takes_for_rare(spark, edits, monkeypatch):
    """A group that is large itself is told so, where a full sketch hides that its gram is frequent."""
    for name, value in (("DEVIATIONS", 10**9), ("OWN", 24)):
        monkeypatch.setattr(ngram_join, name, value)
    test_large_groups_of_near_copies(spark, edits)


def test_a_full_sketch_does_not_hide_which_grams_are_common(spark, monkeypatch):
    """Grams of a tenth of the documents come after those of one, though the small sketch can't tell them apart."""
    for name in ("COUNTERS", "ROW"):
        monkeypatch.setattr(ngram_join, name, 64, raising=False)
    passage = " ".join(f"p{k}" for k in range(20))
    texts = [" ".join([*(f"d{i}w{k}" for k in range(60)), passage if i < 30 else ""]) for i in range(300)]
    order = ngram_join._order(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4)
    common = set(ngram_join.gram_hashes(passage.encode()).tolist())
    for t in texts[:30]:
        h = ngram_join.gram_hashes(t.encode())
        ordered, rare = order.sort(h)
        assert sorted(ordered.tolist()) == h.tolist() and not common & set(ordered[: len(h) // 2].tolist()) and rare >= len(h) // 2


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 700):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        others = [np.unique(np.concatenate([base[: n - k], rng.integers(0, 2**63, j, dtype=np.uint64)])) for k, j in ((0, 0), (n // 10, n // 8), (n // 2, n), (0, 3 * n))]
        apart = ngram_join._apart([ngram_join._sketch(base)], [ngram_join._sketch(x) for x in others])[0]
        assert apart[0] == 0 and all(a <= len(np.setxor1d(base, x)) for a, x in zip(apart, others, strict=True))


def test_hashes_are_those_of_distinct_grams(documents):
    seen = {}
    for r in documents.limit(60).collect():
        h = ngram_join.gram_hashes(r.text.encode())
        assert len(h) == len(grams(r.text))
    for t in ("a b", "a  b", "A B", "b a", "a", "ab", "a b c d", "a b c d e"):
        seen.setdefault(grams(t), set()).add(tuple(ngram_join.gram_hashes(t.encode()).tolist()))
    assert all(len(x) == 1 for x in seen.values()) and len({next(iter(x)) for x in seen.values()}) == len(seen)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert max(Counter(r.node for r in got).values()) == 1
    for r in got:
        assert r.label == find(r.node)
    assert {r.node for r in got} == {x for a, b in edges if a != b for x in (a, b)}


def test_a_bound_of_rounds_is_an_error(spark):
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long"), 1)
