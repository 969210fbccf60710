"""Best-two-fit packing of tokenised documents into sequences.

Lengths are packed, not documents: at most `room` distinct lengths exist, so the histogram of all pieces is small
whatever the corpus. A bin is filled greedily with the longest pieces that fit; then its smallest piece is replaced with
two unpacked ones that fit the expanded gap more tightly. A bin's pattern is repeated while its lengths last, so one step
packs many sequences. Pieces then find their place by their rank among those of their length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, freeing, ranked

ROOM = 4096
END = 1
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoder: dict[str, tuple] = {}
#: Parts remembered per worker (about 230 bytes each), and the longest of them in bytes.
REMEMBERED, LONGEST = 200_000, 64
#: A-Z in lower case, as the tokenizer has them, and a blank for a line end.
_LOWER = bytes(32 if c == 10 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A part of letters alone that white space, case and normal form leave as they are but for lower case, and signs after them that a split sets apart.
_LETTERS = "a-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_SIMPLE = re.compile(rf"([{_LETTERS}]+)([!-&(-/:-@\[-`{{-~][!-/:-@\[-`{{-~]*)?")
#: Letters and marks (diaeresis, ring, caron, line below) that only compose in lower case: there the normal form must come before the case.
_MARKED = re.compile(rb"[HJTWY][\x80-\xff]*(?:\xcc[\x88\x8a\x8c\xb1]|\xcd\x84)")
#: What a tokenizer must say of white space and words for parts to be encoded one by one.
SPACES, WORDS = r"\s+", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _by_parts(path: str) -> bool:
    """Whether this tokenizer lower-cases, drops white space and splits as `encode` supposes; others are given whole texts."""
    import json

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in (told.get("normalizer") or {}).get("normalizers", ())]
    cuts = [(p["type"], p.get("pattern", {}).get("Regex"), p.get("behavior"), p.get("invert"), p.get("add_prefix_space")) for p in (told.get("pre_tokenizer") or {}).get("pretokenizers", ())]
    return steps == [("NFC", None), ("Replace", SPACES), ("Lowercase", None)] and cuts == [("Split", WORDS, "Removed", True, None), ("ByteLevel", None, None, None, False)]


def _tokenizer(path: str) -> tuple:
    if path not in _encoder:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        added = [a.content.encode().translate(_LOWER) for a in t.get_added_tokens_decoder().values()]
        by_parts = _by_parts(path)
        bytes_of = {c: t.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7} if by_parts else {}
        _encoder[path] = (t, {}, added, by_parts, bytes_of)
    return _encoder[path]


def _ids(t, texts: list[str]) -> list[bytes]:
    return [array("I", e.ids).tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def _remember(new: list[bytes], path: str) -> dict[bytes, bytes]:
    """Encode parts that aren't remembered, and remember them as far as there is room; the others are returned.

    A word of plain letters is one word to the splitter, so that the tokenizer's model gets it at once."""
    t, known, _, _, bytes_of = _tokenizer(path)
    once: dict[bytes, bytes] = {}
    model, id_of = t.model, attrgetter("id")

    def put(w: bytes, ids: bytes) -> bytes:
        (known if len(w) <= LONGEST and len(known) < REMEMBERED else once)[w] = ids
        return ids

    def got(w: bytes) -> bytes | None:
        return ids if (ids := known.get(w)) is not None else once.get(w)

    others = []
    for w in new:
        m = _SIMPLE.fullmatch(text := w.decode("utf-8", "replace"))
        if not m:
            others.append((w, text))
            continue
        word, signs = m.groups()
        base, end = (w[: -len(signs)], w[-len(signs) :]) if signs else (w, b"")
        if (ids := got(base)) is None:
            ids = put(base, array("I", map(id_of, model.tokenize(word if word.isascii() else word.lower().translate(bytes_of)))).tobytes())
        if end:
            if (after := got(end)) is None:
                after = put(end, _ids(t, [signs])[0])
            put(w, ids + after)
    for i in range(0, len(others), 20_000):
        some = others[i : i + 20_000]
        for (w, _), ids in zip(some, _ids(t, [x for _, x in some]), strict=True):
            put(w, ids)
    return once


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text, little-endian unsigned 32-bit.

    The default tokenizer drops white space and never joins what it separates, so that a text's ids are those of its parts
    between blanks, one after the other. Each different part of the texts is looked up once, and its ids are dealt out by
    Arrow; the ids of short parts are remembered, also without signs after them.
    When REMEMBERED parts are reached, those that these texts have as well stay, as frequent ones do.
    Texts that hold an added token, in any case, or a mark that _MARKED finds, and all texts of a tokenizer that says otherwise are encoded whole."""
    t, known, added, by_parts, _ = _tokenizer(path)
    plain = lambda x: x.encode("utf-8", "surrogatepass").decode("utf-8", "replace")
    if not by_parts or not texts:
        return _ids(t, [plain(x) for x in texts])
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    lowered = [x.translate(_LOWER) for x in raw]
    marked = {k for k, x in enumerate(raw) if (b"\xcc" in x or b"\xcd\x84" in x) and _MARKED.search(x)}
    whole = {k: plain(texts[k]) for k, x in enumerate(lowered) if k in marked or any(a in x for a in added)}
    if whole:
        ids = {k: _ids(t, [x])[0] for k, x in whole.items()}
        others = iter(encode([x for k, x in enumerate(texts) if k not in whole], path))
        return [ids[k] if k in ids else next(others) for k in range(len(texts))]
    every = b"".join([x + b" " for x in lowered])
    blanks = np.flatnonzero(np.frombuffer(every, np.uint8) == 32)
    starts = np.append(0, blanks - np.arange(len(blanks)))
    parts = pa.Array.from_buffers(pa.large_binary(), len(blanks), [None, pa.py_buffer(starts), pa.py_buffer(every.replace(b" ", b""))]).dictionary_encode()
    different = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
    new = [w for w in different if w not in known]
    if len(known) + len(new) > REMEMBERED:
        frequent = {w: known[w] for w in different if w in known}
        known.clear()
        known.update(frequent)
    once = _remember(new, path)
    found = pa.array([once[w] if w in once else known[w] for w in different], pa.large_binary())
    dealt = found.take(parts.indices)
    at = np.frombuffer(dealt.buffers()[1], np.int64, len(dealt) + 1, 8 * dealt.offset)
    ends = at[np.searchsorted(blanks, np.cumsum([len(x) + 1 for x in lowered]))]
    ids = memoryview(dealt.buffers()[2] or b"")
    return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def tokenised(docs: DataFrame, tokenizer: str | None = None, room: int = ROOM, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: its ids and the end id, cut after each `room` ids."""
    path, last = tokenizer or default_tokenizer(), np.array([end], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                out: list[list] = [[], [], [], [], []]
                for doc, ids in zip(b.column(0).to_pylist(), encode([x or "" for x in b.column(1).to_pylist()], path), strict=True):
                    ids += last
                    for k, i in enumerate(range(0, len(ids), 4 * room)):
                        one = ids[i : i + 4 * room]
                        for o, v in zip(out, (doc, k, i // 4, len(one) // 4, zlib.crc32(one)), strict=True):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(freeing(pieces), PIECE)


def best_two_fit(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, [(length, pieces of it in each)]) patterns that hold every piece once."""
    left = {k: v for k, v in histogram.items() if v > 0}
    lengths = sorted(left)
    patterns = []

    def best_pair(gap: int, used: dict[int, int], above: int) -> tuple[int, int] | None:
        """Two unpacked lengths with the largest sum over `above` and within the gap."""
        free = [x for x in lengths if left[x] > used.get(x, 0)]
        i, j, best, found = 0, len(free) - 1, above, None
        while i <= j:
            a, b = free[i], free[j]
            if i == j and left[a] - used.get(a, 0) < 2:
                break
            if a + b > gap:
                j -= 1
            else:
                if a + b > best:
                    best, found = a + b, (a, b)
                    if best == gap:
                        break
                i += 1
        return found

    while lengths:
        used: dict[int, int] = {}
        gap, i = room, len(lengths) - 1
        while gap > 0 and (i := min(i, bisect_right(lengths, gap) - 1)) >= 0:
            x = lengths[i]
            n = min(left[x], gap // x)
            used[x], gap, i = n, gap - n * x, i - 1
        if gap and sum(used.values()) > 1:
            small = min(used)
            without = {k: v - (k == small) for k, v in used.items() if v > (k == small)}
            if pair := best_pair(gap + small, without, small):
                gap += small - sum(pair)
                used = without
                for x in pair:
                    used[x] = used.get(x, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        patterns.append((times, sorted(used.items(), reverse=True)))
        for x, n in used.items():
            left[x] -= times * n
            if not left[x]:
                del left[x]
                lengths.remove(x)
    return patterns


def pack(docs: DataFrame, tokenizer: str | None = None, room: int = ROOM, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    Null and empty texts are a piece of the end id alone. Rows that repeat an id are packed each for itself. An empty
    table gives an empty result. Only id and text are read.
    """
    pieces = cut(tokenised(docs, tokenizer, room, end, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `room` rows
    slots: dict[int, list[tuple[int, int, int, int]]] = {x: [] for x in histogram}
    taken, sequence = dict.fromkeys(histogram, 0), 0
    for times, items in best_two_fit(histogram, room):
        offset = 0
        for x, n in items:
            slots[x].append((taken[x], n, sequence, offset))
            taken[x] += n * times
            offset += n * x
        sequence += times
    # at most `room` lengths with about as many patterns
    table = {x: np.array(s, dtype=np.int64).T for x, s in slots.items()}
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots_of = shared.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                x = int(length[some[0]])
                first, n, base, offset = slots_of[x]
                k = np.searchsorted(first, rank[some], side="right") - 1
                r = rank[some] - first[k]
                seq[some], off[some] = base[k] + r // n[k], offset[k] + r % n[k] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    r = ranked(pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32"), F.col("start")], "rank")
    return r.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECE + ", sequence_id long, offset long")
