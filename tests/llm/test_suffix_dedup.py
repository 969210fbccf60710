import hashlib
import random
import zlib

import pytest

from rulelake.llm import suffix_dedup


def brute(rows, width=100):
    """rows: (id, text or None) -> per row (bytes, removed, spans, sha) by a dictionary of all strings."""
    docs = sorted({(i is None, i or 0, zlib.crc32((t or "").encode()), (t or "").encode()) for i, t in rows})
    seen, out = set(), {}
    for none, i, crc, b in docs:
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if w in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(w)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[none, i, crc] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return sorted(((i, *out[i is None, i or 0, zlib.crc32((t or "").encode())]) for i, t in rows), key=str)


def hold(docs, **more):
    got = [tuple(r[:5]) for r in suffix_dedup.remove_repeats(docs, **more).collect()]
    assert sorted(got, key=str) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    return got


def test_documents(documents):
    assert sum(r[2] for r in hold(documents)) > 1000


def test_odd(odd):
    hold(odd)


def test_empty(none):
    assert suffix_dedup.remove_repeats(none).collect() == []


def test_passages_copies_and_periods(spark):
    r = random.Random(4)
    word = lambda n: " ".join("".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(n))
    passages = [word(r.randint(15, 90)) for _ in range(8)]
    texts = ["".join(word(r.randint(0, 40)) + r.choice(passages)[r.randint(0, 30) :] for _ in range(r.randint(0, 5))) for _ in range(120)]
    texts += texts[:10] + ["xy" * 300, "z" * 500, "z" * 99, "z" * 100, "xy" * 60, passages[0] * 3, *[passages[1] + word(30) for _ in range(50)]]
    r.shuffle(texts)
    hold(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), bucket_bytes=5000)


def test_anchors_that_many_contexts_share(spark, monkeypatch):
    """Contexts of a hot anchor meet by the bytes on either side of it."""
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    r = random.Random(9)
    word = lambda n: "".join(r.choices("abcdefgh ", k=n))
    line, left, right = word(32), [word(45) for _ in range(4)], [word(45) for _ in range(4)]
    texts = [word(r.randint(0, 60)) + r.choice([*left, word(45)])[r.randint(0, 20) :] + line + r.choice([*right, word(45)])[: r.randint(20, 45)] + word(r.randint(0, 60)) for _ in range(150)]
    assert sum(x[2] for x in hold(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))) > 1000


@pytest.mark.parametrize("width", [33, 300])
def test_other_widths(spark, width):
    r = random.Random(width)
    word = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passages = [word(900) for _ in range(3)]
    texts = [word(50) + r.choice(passages)[r.randint(0, 300) :] + word(40) for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(x[:5]) for x in suffix_dedup.remove_repeats(docs, width=width).collect()]
    assert sorted(got, key=str) == brute(list(enumerate(texts)), width)


@pytest.mark.parametrize("width", [32, 0, 70_000])
def test_widths_that_cannot_be(spark, width):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), width=width)


def test_maximal_repeats():
    got = {(n, tuple(sorted(zip(w.tolist(), p.tolist(), strict=True)))) for n, w, p in suffix_dedup.maximal_repeats([b"xabcdefgy", b"zabcdefgq", b"abcdew"], 4)}
    assert got == {(7, ((0, 1), (1, 1))), (5, ((0, 1), (1, 1), (2, 0)))}
