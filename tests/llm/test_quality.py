import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulelake.llm import quality_gam, weak_quality


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(three)
    covered = {k for i, t in enumerate(three) if n[t] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def hold(docs):
    rows = weak_quality.judge(docs).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    want = sorted(((r.doc_id, *base(r.text)) for r in docs.select("doc_id", "text").collect()), key=key)
    assert sorted((tuple(r[:6]) for r in rows), key=key) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and 0 <= r.quality <= 1
    return rows


def test_rules_on_documents(spark, sf, documents):
    rows = {r.doc_id: r for r in hold(documents)}
    seen = Counter((r.quality, rows[r.doc_id].kept) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not rows[r.doc_id].base_failed)
    assert seen[1, False] <= 0.02 * seen[1, True] and seen[0, True] <= 0.4 * (seen[0, False] + 1)


def test_rules_on_odd(odd, none):
    hold(odd)
    assert weak_quality.judge(none).collect() == []


def test_estimation_finds_planted_kinds(spark):
    """Two kinds of bad documents; the third rule has false alarms that the others don't share."""
    rng, rows = np.random.default_rng(3), []
    for _ in range(20_000):
        kind = rng.choice(3, p=[0.9, 0.06, 0.04])
        v = dict.fromkeys(weak_quality.RULES, 1)
        if kind == 1:
            v |= {"symbols": -1, "upper": -1 if rng.random() < 0.7 else 1}
        if kind == 2:
            v |= {"repeated_words": -1, "variety": -1, "repeated_lines": -1}
        if kind == 0 and rng.random() < 0.003:
            v["repeated_lines"] = -1
        rows.append((*v.values(), kind))
    names = [f"v_{r}" for r in weak_quality.RULES]
    df = spark.createDataFrame([tuple(map(int, r)) for r in rows], [*names, "kind"])
    estimates = weak_quality.estimate(df.groupBy(*names).agg(F.count("*").alias("n")))
    got = df.withColumn("q", weak_quality.quality(estimates)).collect()
    assert abs(estimates[0][0] - 0.9) < 0.02
    assert all((r.q > 0.5) == (r.kind == 0) for r in got)


def test_gam_on_documents(spark, sf, documents):
    rows = quality_gam.classify(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = rows.collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.doc_id in labels and r.held_out]
    assert held and np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.85


def test_gam_on_odd(spark, odd, none, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert quality_gam.classify(odd, labels).count() == odd.count()
    assert {r.score for r in quality_gam.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_gam.classify(none, labels).collect() == []


def test_pairs_learn_what_single_features_cannot():
    x = np.random.default_rng(1).random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    alone, both = quality_gam.fit(x, y, pairs=0), quality_gam.fit(x, y, rounds=160, pairs=3)
    assert np.mean((alone.score(x) > 0.5) == y) < 0.65 < 0.9 < np.mean((both.score(x) > 0.5) == y)


def test_scores_are_sums_of_bins():
    x = np.random.default_rng(2).random((500, 2))
    m = quality_gam.fit(x, (x[:, 0] > 0.3).astype(float), pairs=1)
    one = m.base + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(m.tables, m.edges, x[0], strict=True))
    for (i, j), t in m.pairs.items():
        one += t[np.searchsorted(m.coarse[i], x[0, i], side="right"), np.searchsorted(m.coarse[j], x[0, j], side="right")]
    assert abs(m.score(x[:1])[0] - 1 / (1 + np.exp(-one))) < 1e-12


@pytest.mark.parametrize("rate", [0.005, 0.05, 0.3])
def test_planted_rates_are_recovered(spark, rate):
    """How often a rule condemns good documents, and those of its own kind, comes from the data, within a tenth."""
    rng, n = np.random.default_rng(5), 200_000
    kind = rng.choice(4, n, p=[0.85, 0.05, 0.05, 0.05])
    votes = {}
    for r in weak_quality.RULES:
        own = np.array([False, *[r in rules for rules in weak_quality.KINDS.values()]])[kind]
        condemns = np.where(own, 0.8, np.where((r == "symbols") & (kind == 0), rate, 0.01))
        votes[r] = np.where(rng.random(n) < 0.1, 0, np.where(rng.random(n) < condemns, -1, 1))
    counts = Counter(zip(*[votes[r].tolist() for r in weak_quality.RULES], strict=True))
    schema = ", ".join(f"v_{r} int" for r in weak_quality.RULES) + ", n long"
    shares, rates = weak_quality.estimate(spark.createDataFrame([(*k, c) for k, c in counts.items()], schema))
    assert abs(rates[0]["symbols"] / rate - 1) < 0.1 and abs(shares[0] - 0.85) < 0.01
    assert all(abs(rates[y][r] / 0.8 - 1) < 0.1 for y, rules in enumerate(weak_quality.KINDS.values(), 1) for r in rules)


def test_words_without_letters(spark):
    texts = ["1 a 2b !! é %% &&&", "", None, "12\t34\n56", "x1x"]
    rows = weak_quality.measures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_wordless for r in rows] == [4, 0, 0, 3, 0] and [r.n_marks for r in rows] == [9, 0, 0, 6, 1]
