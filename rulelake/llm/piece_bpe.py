"""Exact encoding with a merge-type SentencePiece model by backtracking, and decoding.

Merging takes the best pair of neighbours again and again, so a piece depends on what lies around it. But a sequence of
pieces is the merged one if and only if each two neighbours, merged alone from their characters, come out as
themselves. So a text is read from the left: an Aho-Corasick automaton gives the longest piece at each place; a piece is
taken if it goes with the one before (the two are merged again, and the answer is kept), else a shorter one is tried. Where
none goes, the place is marked in a bitfield as failed and the piece before is replaced by a shorter one. No place fails
twice, so the time is linear in the text.

No piece of a usual model holds a blank mark after another character; then stretches from blank to blank are encoded apart,
and those met before are looked up.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col

BLANK = "▁"
#: Stretches and pairs kept per worker, and the longest stretch that is kept, in characters.
KEPT, LONGEST = 300_000, 64
#: A text is taken in blocks of about so many characters.
BLOCK = 1 << 20
_STRETCH = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_models: dict[str, Pieces] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer."""

    def number() -> int:
        nonlocal at
        shift = out = 0
        while True:
            b, at = message[at], at + 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    at = 0
    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at : at + size]
            at += size


class Pieces(dict):
    """A model in a worker: stretches of normalised text, and the bytes of their ids."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        super().__init__()
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        trained = dict(_fields(next(v for k, v in _fields(m.serialized_model_proto()) if k == 2)))
        plain = [i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        # user-defined pieces (type 4) are cut out before merging, unused ones (5) are taken apart after it
        kinds = {dict(_fields(v)).get(3, 1) for k, v in _fields(m.serialized_model_proto()) if k == 1}
        if trained.get(3, 1) != 2 or kinds & {4, 5}:
            raise ValueError(f"{path} is no merge-type model of normal pieces")
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.score = {m.id_to_piece(i): m.get_score(i) for i in plain}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(map(m.is_byte, range(m.vocab_size()))) else None
        self.unknown, self.ends = m.unk_id(), (m.bos_id(), m.eos_id())
        #: Whether stretches can be encoded apart, unknown characters in them as well.
        self.apart = self.bytes is not None and not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        self.goes: dict[tuple[str | None, str], bool] = {}
        #: The longest piece, or single character, that a piece begins with.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in self.ids), None) for p in self.ids}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: the best pair first, the leftmost of equal ones."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, last: str | None, piece: str) -> bool:
        """Whether both stay as they are where they meet (a first piece: alone)."""
        if len(self.goes) >= KEPT:
            self.goes.clear()
        known = self.goes[last, piece] = self.merged((last or "") + piece) == ([piece] if last is None else [last, piece])
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces of a normalised text that isn't empty; characters of no piece stand for themselves."""
        longest, goes, shorter = list(text), self.goes, self.shorter
        for end, (before, piece) in self.automaton.iter(text):  # of a place's pieces, the longest ends last
            longest[end - before] = piece
        failed, some, size = bytearray(len(text) // 8 + 1), False, len(text)
        made: list[str] = []
        last, at, piece = None, 0, longest[0]
        while True:
            end = at + len(piece)
            if some and failed[end >> 3] >> (end & 7) & 1:
                fits = False
            else:
                fits = goes.get((last, piece))
                if fits is None:
                    fits = self.compatible(last, piece)
            if fits:
                made.append(piece)
                if end == size:
                    return made
                last, at, piece = piece, end, longest[end]
            else:
                piece = shorter.get(piece)
                while piece is None:  # nothing goes on from here
                    failed[at >> 3] |= 1 << (at & 7)
                    some, piece = True, made.pop()
                    at -= len(piece)
                    last, piece = made[-1] if made else None, shorter.get(piece)

    def numbers(self, pieces: list[str]) -> list[int]:
        """Ids of pieces. Other characters become their bytes, or one unknown id for each run of them."""
        out: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.bytes is not None:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def __missing__(self, stretch: str) -> bytes:
        found = array("I", self.numbers(self.pieces(stretch))).tobytes()
        if len(stretch) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[stretch] = found
        return found

    def encode(self, text: str) -> bytes:
        """Begin id, ids of the text and end id, each as four bytes, the lowest first."""
        text = self.model.normalize(text)
        out = [array("I", self.ends[:1]).tobytes()]
        at = 0
        while self.apart and at < len(text):
            end = at + BLOCK
            while 0 < (end := text.find(BLANK, end)) and text[end - 1] == BLANK:
                end += 1
            end = end if end > 0 else len(text)
            out += map(self.__getitem__, _STRETCH.findall(text, at, end))
            at = end
        if text and not self.apart:
            out.append(array("I", self.numbers(self.pieces(text))).tobytes())
        return b"".join([*out, array("I", self.ends[1:]).tobytes()])


def loaded(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _each(rows: DataFrame, value: str, drop: bool, **columns: tuple[str, Callable]) -> DataFrame:
    """rows with further columns: (type, function of the value, or of the column before) each, a few hundred rows at a time."""
    kinds = {"binary": pa.binary(), "string": pa.string()}
    kept = [f for f in rows.schema if not (drop and f.name == value)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                out, now = [b.column(f.name) for f in kept], b.column(value)
                for kind, one in columns.values():
                    now = pa.array([one(x.as_py()) for x in now], kinds[kind])
                    out.append(now)
                yield pa.RecordBatch.from_arrays(out, names=[*(f.name for f in kept), *columns])

    return rows.mapInArrow(run, T.StructType([*kept, *[T.StructField(k, T._parse_datatype_string(kind)) for k, (kind, _) in columns.items()]]))


def _encoded(model: str) -> tuple[str, Callable]:
    return "binary", lambda text: loaded(model).encode(text or "")


def _decoded(model: str) -> tuple[str, Callable]:
    return "string", lambda ids: loaded(model).model.decode(np.frombuffer(ids, "<u4").tolist()) if ids else ""


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary: unsigned 32-bit numbers, the lowest byte first) of every row of docs, with begin and end id.

    Null and empty texts are the begin and end id alone. Rows that repeat an id, or have none, are encoded each for itself.
    An empty table gives an empty result; only id and text are read. `model` is a file of a merge-type model that all
    executors can read; a model of another type, or with user-defined or unused pieces, is an error."""
    return _each(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), "text", True, ids=_encoded(model or default_model()))


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """Adds the text that the model's decode(ids) gives, as `decoded`, to rows(ids, ...); null ids give an empty one."""
    return _each(rows, "ids", False, decoded=_decoded(model or default_model()))


def round_trip(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass, with one worker's memory."""
    model = model or default_model()
    return _each(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), "text", True, ids=_encoded(model), decoded=_decoded(model))


def unpacked(ids: Column) -> Column:
    """ids as an array of numbers; null for null."""
    digits = lambda k: F.hex(F.substring(ids, 4 * k + 1, F.lit(4)))
    number = lambda h: F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), (F.octet_length(ids) / 4).cast("int") - 1), lambda k: number(digits(k)))
