import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from rulelake.llm import exact_dedup


def hold(docs, **more):
    groups = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        groups[(r.text or "").translate({c: None for c in (32, *range(9, 14))})].append((r.doc_id, r.text or ""))
    want = []
    for body, g in groups.items():
        keep = min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        want += [(i, keep, len(g), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i, _ in g]
    rows = [tuple(r[:5]) for r in exact_dedup.exact_dedup(docs, **more).collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_documents(documents):
    hold(documents, keys_per_bucket=50)


def test_snapshots(documents):
    hold(documents, in_snapshot=F.lit(True))
    hold(documents, in_snapshot=F.lit(False))


def test_odd(odd):
    hold(odd)


def test_empty(none):
    assert exact_dedup.exact_dedup(none).collect() == []


def test_filters_miss_nothing():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 1000, 60_000):
        keys = rng.integers(0, 2**63, n + 1000, dtype=np.uint64)
        f = exact_dedup.build_filter(np.unique(keys[:n]))
        assert exact_dedup.may_contain(keys[:n], *f).all()
        assert exact_dedup.may_contain(keys[n:], *f).mean() < 0.03
        if n > 10_000:
            assert len(f[3]) < 1.3 * n


def test_bytes_are_compared_where_the_best_row_has_no_id(spark):
    """Both sides of a class must be read before they are called equal, whatever their ids."""
    from pyspark.sql import functions as F

    rows = [(None, "same  text here", False), (5, "same text here", True), (6, "sametexthere", True), (7, "other", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old boolean")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, in_snapshot=F.col("old")).collect()}
    assert got == {None: (None, 3), 5: (None, 3), 6: (None, 3), 7: (7, 1)}
