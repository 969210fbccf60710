"""Merge-type encoding by backtracking: the library's own ids and decoded texts, for whole tables, odd texts and random ones."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from rulelake.llm import piece_bpe
from rulelake.llm import queries as Q

ODD = ["", " ", "  ", "a", " a", "a b  c ", "▁x", "▁▁ x▁y", "\n", "<s>", "</s> <unk>", "<0x41>", "é\x00x", "ﬁ ½ Ａ", "a\tb", "\u3000x", "🦙🦙", "a" * 5000, "ab" * 3000, " " * 3000, "\n" * 1000, "abcabcab" * 99, "x\u0301", "\ufffd", "\u200b \u00a0"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())


def ids(library, text):
    return library.encode(text, add_bos=True, add_eos=True)


def same(library, text):
    assert np.frombuffer(piece_bpe.loaded(piece_bpe.default_model()).encode(text), "<u4").tolist() == ids(library, text), text[:100]


def test_odd_and_random_texts(library):
    r, pieces = random.Random(7), list(piece_bpe.loaded(piece_bpe.default_model()).ids)
    for t in ODD:
        same(library, t)
    for _ in range(4000):
        same(library, "".join(r.choice("abcdeinostrth  ▁\n.,éß🦙0123") for _ in range(r.randint(0, 40))))
        same(library, "".join(r.choice(pieces) for _ in range(r.randint(0, 8))))


def test_long_texts_and_full_caches(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "KEPT", 50)
    monkeypatch.setattr(piece_bpe, "BLOCK", 7)
    r = random.Random(3)
    same(library, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 90))) + "  " * r.randint(0, 2) for _ in range(3000)))
    same(library, "".join(r.choice("abcdefghijklmnop") for _ in range(60_000)))


def test_a_place_fails_once(library):
    """The longest pieces at a place are often wrong; each place is given up once at most."""
    model = piece_bpe.loaded(piece_bpe.default_model())
    pieces = model.pieces("▁" + "ab" * 500 + "abcd" * 500)
    assert "".join(pieces) == "▁" + "ab" * 500 + "abcd" * 500
    assert model.merged("▁the") == ["▁the"] and not model.compatible("▁t", "he") and model.compatible(None, "▁the")
    assert model.shorter["▁the"] == "▁th" and model.shorter["a"] is None


def test_query(spark, sf, library, documents):
    texts = {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
    rows = Q.queries()["op13_piece_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = ids(library, texts[r.doc_id])
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_odd_tables(spark, odd, none, library):
    rows = piece_bpe.decode(piece_bpe.encode(odd)).withColumn("list", piece_bpe.unpacked(F.col("ids"))).collect()
    want = sorted(str((r.doc_id, ids(library, r.text or ""), library.decode(ids(library, r.text or "")))) for r in odd.collect())
    assert sorted(str((r.doc_id, r.list, r.decoded)) for r in rows) == want
    assert sorted(map(str, piece_bpe.round_trip(odd).collect())) == sorted(str(r) for r in piece_bpe.decode(piece_bpe.encode(odd)).collect())
    assert piece_bpe.round_trip(none).collect() == [] and piece_bpe.decode(piece_bpe.encode(none)).collect() == []


def test_other_models_are_errors(tmp_path):
    with pytest.raises(Exception):
        piece_bpe.loaded(str(tmp_path / "none.model"))
