"""SentencePiece encoding and decoding inside Spark tasks, for merge-type vocabularies.

A text's characters are symbols; an agenda holds the pairs of adjacent symbols whose joined string is a piece, best
score first and leftmost among equals, and joins the best until none is left. Symbols that are no piece become the
pieces of their bytes. A space is the sign U+2581, one stands before the text, and no other normalising is done: a
model file that asks for more is refused.

Where no piece holds that sign behind another character, no pair reaches over such a place, so each word has an agenda
of its own and short words are remembered. With ``checked`` the sentencepiece library encodes, after each Arrow batch,
all words that were not remembered from one before, and a column says whether every word of a text has its ids.

The tables come from a model file whose path is a parameter and whose size bounds what is sent to the executors. Each
row is handled on its own: no shuffle.

Defined results: a null text is empty, and an empty text has the begin and end ids only. Very long texts, and words
without any space, take n log n steps and memory for their own symbols. Repeated rows give repeated results, a null id
stays null, other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import OUTPUT_ROWS, Remembered
from .common import texts_in

#: The sign that stands for a space (fixed by the format).
SPACE = "▁"
#: Kinds of pieces and the type of merging models (fixed by the format).
NORMAL, UNKNOWN, CONTROL, BYTE, MERGING = 1, 2, 3, 6, 2
#: Symbols up to which an agenda is a plain list, and what stands in it for a pair that is no piece.
WORD, NEVER = 40, float("inf")
#: Short words that a worker process remembers, from task to task.
WORDS_HELD = 500_000

codecs.register_error("lectorium-each-byte", lambda e: ("�", e.start + 1))


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields; those inside messages stay bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value, at, more = value | (message[at] & 127) << shift, at + 1, message[at] & 128
            shift += 7
            if not more:
                return value, at

    at = 0
    while at < len(message):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = message[at : at + size], at + size
        yield key >> 3, value


class Pieces:
    """What a model file holds: small, picklable, the same on every executor."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = f.read()
        rows, parts = [], {}
        for n, value in _fields(self.model):
            if n == 1:
                rows.append(dict(_fields(value)))
            else:
                parts[n] = dict(_fields(value))
        trainer, normalizer = parts[2], parts[3]
        kinds = [r.get(3, NORMAL) for r in rows]
        plain = not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1) and not trainer.get(24)
        if trainer.get(3) != MERGING or not trainer.get(35) or not plain or set(kinds) > {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} is not a merging vocabulary with pieces for bytes and without normalising")
        names = [r[1].decode() for r in rows]
        of = lambda kind: {names[i]: i for i, k in enumerate(kinds) if k == kind}
        self.ids = of(NORMAL)
        #: The best score comes first.
        self.turns = {names[i]: -struct.unpack("<f", rows[i].get(2, bytes(4)))[0] for i in self.ids.values()}
        self.bytes = [of(BYTE)[f"<0x{b:02X}>"] for b in range(256)]
        self.begin, self.end = of(CONTROL)[trainer.get(46, b"<s>").decode()], of(CONTROL)[trainer.get(47, b"</s>").decode()]
        unknown = trainer.get(44, " ⁇ ".encode()).decode()
        self.surfaces: list[bytes] = [unknown.encode() if k == UNKNOWN else b"" if k == CONTROL else name.replace(SPACE, " ").encode() for name, k in zip(names, kinds, strict=True)]
        for b, i in enumerate(self.bytes):
            self.surfaces[i] = bytes([b])
        self.spaced = {i for name, i in self.ids.items() if name.startswith(SPACE)}
        self.silent, self.raw = set(of(CONTROL).values()), set(self.bytes)
        #: No piece reaches over a place where a space follows another character, so a cut there is certain.
        self.words_apart = not any(SPACE in name.lstrip(SPACE) for name in self.ids)

    def symbols(self, text: str) -> list[str]:
        """The symbols that are left when the agenda is empty.

        For a word it is a list in order of places, of which the least is taken; for more a heap over linked symbols.
        """
        if len(text) > WORD:
            return self._symbols_of_long(text)
        symbols, turn = list(text), self.turns.get
        agenda = [turn(text[i : i + 2], NEVER) for i in range(len(text) - 1)]
        while agenda and (least := min(agenda)) < NEVER:
            i = agenda.index(least)
            del agenda[i]
            symbols[i] += symbols.pop(i + 1)
            if i < len(agenda):
                agenda[i] = turn(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = turn(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def _symbols_of_long(self, text: str) -> list[str]:
        n, turn = len(text), self.turns.get
        symbols, left, right = list(text), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(s, i, i + 1, 2) for i in range(n - 1) if (s := turn(text[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of them has been joined to another since
            symbols[i], symbols[j] = symbols[i] + symbols[j], ""
            after = right[i] = right[j]
            if after < n:
                left[after] = i
            for x, y in ((left[i], i), (i, after)):
                if x >= 0 and y < n:
                    joined = symbols[x] + symbols[y]
                    if (s := turn(joined)) is not None:
                        heapq.heappush(agenda, (s, x, y, len(joined)))
        return [s for s in symbols if s]

    def packed(self, text: str) -> bytes:
        """Ids of a text without spaces' begin and end, as little-endian 32-bit integers."""
        found = []
        for s in self.symbols(text):
            if (i := self.ids.get(s)) is not None:
                found.append(i)
            else:
                found.extend(self.bytes[b] for b in s.encode())
        return struct.pack(f"<{len(found)}I", *found)


class Encoder:
    """From a text to its ids with begin and end, packed as little-endian 32-bit integers."""

    def __init__(self, pieces: Pieces, library=None):
        self.pieces, self.library = pieces, library
        self.begin, self.end = struct.pack("<I", pieces.begin), struct.pack("<I", pieces.end)
        self.find = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if pieces.words_apart else lambda text: [text]
        self.remembered = Remembered(self._first)
        self.remembered.room = WORDS_HELD
        self.unchecked: dict[str, bytes] = {}
        self.wrong: set[str] = set()

    def words(self, text: str) -> list[str]:
        return self.find(SPACE + text.replace(" ", SPACE)) if text else []

    def _first(self, word: str) -> bytes:
        packed = self.pieces.packed(word)
        if self.library is not None:
            self.unchecked[word] = packed
        return packed

    def __call__(self, text: str) -> bytes:
        return b"".join((self.begin, *map(self.remembered.__getitem__, self.words(text)), self.end))

    def same_as_library(self, texts: list[str]) -> list[bool]:
        """Whether the library gives every word of each text (encoded since the last call) the same ids."""
        words = list(self.unchecked)
        # a word begins with the sign that the library puts before a text
        wanted = self.library.encode([w[1:].replace(SPACE, " ") for w in words], num_threads=1)
        for w, ids in zip(words, wanted, strict=True):
            if struct.pack(f"<{len(ids)}I", *ids) != self.unchecked[w]:
                self.wrong.add(w)
        self.unchecked.clear()
        return [not self.wrong or self.wrong.isdisjoint(self.words(t)) for t in texts]


_held: dict[bytes, Encoder] = {}


def held_encoder(pieces: Pieces, checked: bool) -> Encoder:
    """The encoder of this worker process for a model: the words that it remembers outlast a task."""
    key = hashlib.sha256(pieces.model).digest() + bytes([checked])
    if key not in _held:
        import sentencepiece

        _held.clear()
        _held[key] = Encoder(pieces, sentencepiece.SentencePieceProcessor(model_proto=pieces.model) if checked else None)
    return _held[key]


def decoder(pieces: Pieces):
    """A function from packed ids to the text. A byte that is no part of a character becomes a replacement character."""
    surfaces, spaced, silent, raw = pieces.surfaces, pieces.spaced, pieces.silent, pieces.raw

    def decode(packed: bytes) -> str:
        ids = memoryview(packed).cast("I")
        first = next((i for i in ids if i not in silent), None)
        skip = 1 if first in spaced else 0  # the space that stood before the text
        joined = b"".join(map(surfaces.__getitem__, ids))
        try:
            return joined[skip:].decode()
        except UnicodeDecodeError:
            pass
        out, run = [], b""
        for i in ids:
            if i in raw:
                run += surfaces[i]
            else:
                out += [run.decode("utf-8", "lectorium-each-byte"), surfaces[i].decode()]
                run = b""
        return "".join([*out, run.decode("utf-8", "lectorium-each-byte")])[skip:]

    return decode


def encode_decode(docs: DataFrame, path: str, digest: bool = False, checked: bool = False) -> DataFrame:
    """doc_id, n_tokens and, for every row of ``docs`` (columns doc_id and text), ids and decoded_text.

    With ``digest`` their SHA-256 instead, with ``checked`` also same_as_library.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        encode, decode = held_encoder(pieces, checked), decoder(pieces)
        for whole in batches:
            for b in (whole.slice(i, OUTPUT_ROWS) for i in range(0, whole.num_rows, OUTPUT_ROWS)):
                texts = [t or "" for t in b.column("text").to_pylist()]
                packed = [encode(t) for t in texts]
                decoded = map(decode, packed)
                cells = {"doc_id": b.column("doc_id"), "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64())}
                if digest:
                    cells |= {"ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()), "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())}
                else:
                    ends = np.cumsum([0] + [len(p) // 4 for p in packed], dtype=np.int32)
                    cells |= {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32))), "decoded_text": pa.array(decoded, pa.string())}
                if checked:
                    cells["same_as_library"] = pa.array(encode.same_as_library(texts), pa.bool_())
                yield pa.RecordBatch.from_pydict(cells)

    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded_text string"
    return texts_in(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, {tail}" + ", same_as_library boolean" * checked)
