import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rulelake.llm import packing


def hold(docs, slack):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(r.doc_id, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    rows = packing.pack(docs).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) * slack + 1


def test_documents(documents):
    hold(documents, 1.02)


def test_odd(odd):
    hold(odd, 1.3)


def test_empty(none):
    assert packing.pack(none).collect() == []


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_patterns_hold_every_piece_once(histogram):
    got = defaultdict(int)
    for times, items in packing.best_two_fit(histogram, 64):
        assert sum(x * n for x, n in items) <= 64 and times >= 1
        for x, n in items:
            got[x] += times * n
    assert dict(got) == histogram


def test_the_smallest_gives_way_to_two():
    # 60 + 3 leaves a gap of 1; 3 gives way to 2 + 2
    assert packing.best_two_fit({60: 1, 3: 1, 2: 2}, 64)[0][1] == [(60, 1), (2, 2)]


@pytest.mark.parametrize("text", ["a'S it'll  don't", "ΣΑΣ σας", "é ́x", " a b\x1cc", "İ ǅ", "Dé, a!, b. c.. d ÷, x", "é., y…, z.", "3. a%. b,, 1, x.", ". , .. a", "don't. can't,"])
def test_parts_are_encoded_like_the_whole(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    assert np.frombuffer(packing.encode([text], packing.default_tokenizer())[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "x<|startoftext|>Y.\n<|endoftext|>", "a <|ENDOFTEXT|> b", "<|endof text|> plain"])
def test_added_tokens_are_those_of_the_file(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.encode(["one two", text, "three."], packing.default_tokenizer())
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in ("one two", text, "three.")]


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    t, known, *_ = packing._tokenizer(path)
    known.clear()
    monkeypatch.setattr(packing, "REMEMBERED", 300)
    for k in range(5):  # more parts in all, and in the last texts alone, than are remembered
        texts = ["often. " + " ".join(f"w{i}x{k}" + ".,a"[i % 3] for i in range(1000 if k == 4 else 120)), "often, seen"]
        got = packing.encode(texts, path)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(known) <= 300 + 1 and b"often." in known


@pytest.mark.parametrize("text", ["J\u030c", "a T\u0308\u0301, H\u0331.", "T\u0344", "W\u030a Y\u030a"])
def test_case_and_normal_form_in_the_tokenizer_order(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    for texts in ([text], ["one", text, "two."]):  # alone, no text is left for the parts
        assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode(texts, packing.default_tokenizer())] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(st.sampled_from("aAbZ\u00e9\u00c9\u00df\u00ff\u0178\u00d7\u00f7\u00aa'sSt.,-&([ 0\u00b2\n\u00a0\u0130\u03a3\u01c5\u0300\u65e5"), max_size=30), max_size=4))
def test_letters_and_signs_are_encoded_like_the_whole(texts):
    t = packing._tokenizer(packing.default_tokenizer())[0]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode(texts, packing.default_tokenizer())] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_new_words_skip_the_splitter(monkeypatch):
    """Most words are new to a worker in a large corpus. Plain ones go to the model at once, which takes a third of the time."""
    path = packing.default_tokenizer()
    t, known, *_ = packing._tokenizer(path)
    known.clear()
    slow, ids = [], packing._ids
    monkeypatch.setattr(packing, "_ids", lambda t, texts: slow.extend(texts) or ids(t, texts))
    words = [f"{a}{b}e{c}" for a in "rstÉ" for b in ("", "la", "ü") for c in ("nt", "ß.", "r,", "n&&&", "s")]
    got = packing.encode([" ".join(words), "x²y"], path)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in (" ".join(words), "x²y")]
    assert sorted(slow) == ["&&&", ",", ".", "x²y"]


def test_memory_is_given_back():
    import os
    import subprocess
    import sys
    from pathlib import Path

    # a worker's memory after a task that needs much: of a new process, as others have freed memory of their own
    code = """if True:
        import re
        from pathlib import Path
        import numpy as np
        from rulelake.llm.common import freeing
        used = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
        def task(batches):
            for b in batches:
                kept = [np.ones(4000) for _ in range(4000)]
                pins.append(np.ones(4000))  # above what is freed
                yield b
        pins, at = [], used()
        assert list(freeing(task)(iter([1]))) == [1]
        print(used() - at)
    """
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": str(Path(packing.__file__).parents[2])}, capture_output=True, text=True, check=True)
    assert float(out.stdout) < 30
