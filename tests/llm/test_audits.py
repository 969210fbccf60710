"""Audits of filters and sources against counting one by one."""

import itertools
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rulelake.llm import filter_audit, source_audit


def filters(rows):
    """The letters of the filters that each row fails. rows: (id, text)."""
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), t in least and (i is None or least[t] < i))
        yield {x for x, f in zip("ABCDE", fails, strict=True) if f}


def brute_audit(docs, labels):
    rows = docs.select("doc_id", "text", "lang").collect()
    good, toxic = ({r.doc_id for r in labels.collect() if r[k] == 1} for k in ("quality", "toxic"))
    parts = defaultdict(list)
    for r, f in zip(rows, filters([(r.doc_id, r.text) for r in rows]), strict=True):
        parts[r.lang or ""].append((f, r.doc_id in good, r.doc_id in toxic))
    out = set()
    for part, members in parts.items():
        removed = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = members
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [m for m in left if x in m[0]]
                left = [m for m in left if x not in m[0]]
                removed[order, x] = len(here)
                late = sum(x in f and bool(f & before) for f, _, _ in members)
                alone = sum(f == {x} for f, _, _ in members)
                out.add((part, order, step, x, len(left), len(here), late, alone, sum(m[1] for m in here), sum(m[2] for m in here)))
        shares = Counter()
        for (_, x), n in removed.items():
            shares[x] += n
        out = {(*r, shares[r[3]]) if r[0] == part and len(r) == 10 else r for r in out}
    return {r[:3] + r[4:] for r in out}


def test_filters_one_by_one(spark, sf, documents, odd, none):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for docs in (documents, odd):
        got = filter_audit.audit(docs, labels).collect()
        assert {tuple(r) for r in got} == brute_audit(docs, labels) and len(got) == 600 * len({r.part for r in got})
    assert filter_audit.audit(none, labels).collect() == []


def test_labels_that_repeat_or_lack(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a", None), (3, "b", ""), (None, "b", "x"), (None, "c", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in filter_audit.audit(docs, labels).collect()} == {r for r in brute_audit(docs, labels.filter("doc_id is not null"))}


def test_sums_give_back_cells(spark):
    """Any number of filters: the transform is inverted exactly, large counts too."""
    rows = [("p", 0, 0, m, 10**15 + m * m) for m in range(8)] + [("q", 1, 0, 5, 3), ("q", 1, 1, 5, 4)]
    df = spark.createDataFrame(rows, "part string, good int, toxic int, mask int, n long")
    got = {r.part: r for r in filter_audit.cells(filter_audit.parity_sums(df, 3), 3).collect()}
    assert got["p"].every == [10**15 + m * m for m in range(8)] and got["p"].good == [0] * 8
    assert got["q"].every == [0, 0, 0, 0, 0, 7, 0, 0] and got["q"].toxic == [0, 0, 0, 0, 0, 4, 0, 0]
    steps = filter_audit.evaluated(filter_audit.cells(filter_audit.parity_sums(df, 3), 3), "ABC").filter("part = 'q'").collect()
    assert {(r.filter_order, r.step): r.removed for r in steps if r.removed} == {(o, min(o.index("A"), o.index("C")) + 1): 7 for o in map("".join, itertools.permutations("ABC"))}
    assert {r.shapley for r in steps} == {0, 21}


def brute_divergence(rows):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for lang, source, t in rows]
    docs, n, groups = Counter(), Counter(), sorted({(a, b) for a, b, _ in terms})
    for lang, source, w in terms:
        docs.update((lang, x) for x in set(w))
        n.update((lang, source, x) for x in w)
    out = set()
    for lang in {a for a, _ in groups}:
        kept = [x for (a, x), d in docs.items() if a == lang and d >= 3]
        sources = [b for a, b in groups if a == lang]
        size = {s: sum(n[lang, s, x] for x in kept) for s in sources}
        p = {(s, x): 1 + 10**9 * (n[lang, s, x] + 1) // (size[s] + len(kept)) for s in sources for x in kept}
        q = {x: 1 + 10**9 * (sum(n[lang, s, x] for s in sources) + 1) // (sum(size.values()) + len(kept)) for x in kept}
        for s in sources:
            pairs = [(-sum((p[s, x] - p[r, x]) ** 2 // p[r, x] for x in kept), r.encode()) for r in sources if r != s]
            found = [(-((p[s, x] - q[x]) ** 2 // q[x]), x.encode()) for x in kept if n[lang, s, x] and p[s, x] > q[x]]
            for part, items in (("pair", pairs), ("term", found)):
                out |= {(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(sorted(items), 1) if part == "pair" or k <= 200}
    return out


def test_sources_one_by_one(spark, documents, odd, none, monkeypatch):
    for docs in (documents, odd):
        want = brute_divergence([(r.lang, r.source, r.text) for r in docs.collect()])
        assert {tuple(r) for r in source_audit.divergence(docs).collect()} == want
    monkeypatch.setattr(source_audit, "HELD", 5)
    assert {tuple(r) for r in source_audit.divergence(odd).collect()} == brute_divergence([(r.lang, r.source, r.text) for r in odd.collect()])
    assert source_audit.divergence(none).collect() == []


def test_groups_without_terms_and_ties(spark):
    rows = [("a", "x", "Foo foo bar"), ("a", "x", "foo bar"), ("a", "y", "FOO bar baz"), ("a", None, None), ("a", "z", "12 34"), ("b", "x", ""), ("b", "y", "once"), (None, None, "é é É"), (None, "y", "é"), ("", "w", "é É")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = {tuple(r) for r in source_audit.divergence(docs).collect()}
    assert got == brute_divergence(rows)
    assert {r[4] for r in got if r[0] == "b"} == {0} and {r[3] for r in got if r[:3] == ("a", "", "pair")} == {"x", "y", "z"}


def test_counts_beyond_64_bits(spark):
    one = F.lit(1).cast("long")
    big = spark.createDataFrame([(5 * 10**17, 2 * 10**18, 7), (9 * 10**18, 9 * 10**18, 1), (0, 0, 0)], "c long, t long, v long")
    rows = big.select(source_audit.share(F.col("c"), F.col("t"), F.col("v")).alias("p"), one).collect()
    assert [r.p for r in rows] == [1 + 10**9 * (5 * 10**17 + 1) // (2 * 10**18 + 7), 1 + 10**9 * (9 * 10**18 + 1) // (9 * 10**18 + 1), 1]
