import zlib
from collections import Counter

import numpy as np

from rulelake.llm import queries, sharding


def hold(docs, shards=40, **more):
    rows = sharding.shard(docs, shards, **more).collect()
    given = Counter((r.doc_id, r.text) for r in docs.collect())
    assert Counter((r.doc_id, r.text) for r in rows) == given
    counts = Counter(r.shard for r in rows)
    n = [counts[s] for s in range(shards)]
    assert max(n) - min(n) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    return {(r.doc_id, r.text, r.shard, r.slot) for r in rows}


def test_documents(documents):
    assert hold(documents) == hold(documents.repartition(5))
    assert hold(documents, bucket_bytes=20_000) != hold(documents, bucket_bytes=20_000, seed=3)


def test_odd(odd):
    hold(odd, 3)
    assert sharding.shard(odd, 3).columns[:-3] == [c for c in odd.columns if c != "position"]


def test_empty(none):
    assert sharding.shard(none).collect() == []


def test_permutations_are_uniform():
    rng, seen = np.random.default_rng(5), Counter()
    for _ in range(6000):
        seen[tuple(sharding.fisher_yates(3, rng))] += 1
    assert len(seen) == 6 and min(seen.values()) > 850


def test_written_shards(spark, documents, tmp_path):
    sharding.write_shards(sharding.shard(documents), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == documents.count()


def test_query(spark, sf, documents):
    text = {r.doc_id: r.text for r in documents.collect()}
    for r in queries.op4(spark, sf).collect():
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
