import re
from collections import Counter

from rulelake.llm import mixing


def targets(sizes):
    """Sharing by weight, one capped source after another."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        left, w = total - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] > 3 * sizes[s] * w]
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        for s in over:
            out[s] = 3 * sizes[s]
        free -= set(over)
    return out


def hold(docs, spark):
    given = docs.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in given:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = targets(dict(sizes))
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(given)
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert sum(p.words for p in r.placements) == r.taken and all(0 <= p.position <= 1 for p in r.placements)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    return rows


def test_documents(spark, documents):
    a, b = hold(documents, spark), hold(documents.repartition(7), spark)
    assert sorted((r.doc_id, r.taken) for r in a) == sorted((r.doc_id, r.taken) for r in b)


def test_odd(spark, odd):
    hold(odd, spark)


def test_empty(none):
    assert mixing.schedule(mixing.mix(none)).collect() == []


def test_whole(spark, documents):
    for r in mixing.mix(documents, whole=True).collect():
        assert r["size"] == 0 or r.taken % r["size"] == 0


def test_heavy_sources_come_early(spark, documents):
    rows = mixing.schedule(mixing.mix(documents)).filter("position is not null").collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    names = sorted({r.source for r in rows})
    light = set(names[2::3])
    early = lambda some: sum(r.words for r in rows if r.source in some and r.position < 0.5) / sum(r.words for r in rows if r.source in some)
    # areas before one half: 0.625 of 1.5 .. 0.5, 0.375 of 0.5 .. 1.5; a document counts where it starts
    assert 0.5 < early(set(names[0::3])) < 0.75 and early(light) < early(set(names[0::3]))


def test_query_gives_a_row_for_each_document(spark, odd, none, tmp_path):
    """The query over rows that repeat ids, a source without words, and no rows."""
    from rulelake.llm import queries

    for docs in (odd, none):
        path = str(tmp_path / str(docs.count()))
        docs.write.parquet(f"{path}/documents.parquet")
        rows = queries.op2(spark, path).collect()
        assert len(rows) == docs.count()
        assert [r.first_position for r in rows if r.first_position is not None] == sorted(r.first_position for r in rows if r.first_position is not None)
        sizes = Counter()
        for r in docs.select("text", "source").collect():
            sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert abs(sum(r.taken for r in rows) - sum(targets(dict(sizes)).values())) <= len(sizes)
