"""Byte-pair tokenising inside Spark tasks: token counts and encoding with decoding.

Both operators split a text at special strings and then into pre-tokens, as the tokenizer file prescribes, and
differ in how they avoid merging:

* ``count_tokens`` proves once, before any document is read, which vocabulary strings encode alone as exactly one
  token, counts pre-tokens that are such strings directly and merges only the rest.
* ``encode_decode`` cuts every pre-token between two bytes that never stand side by side inside any vocabulary
  token (no merge can cross such a place), encodes the fragments independently and concatenates.

The tables come from a tokenizer file whose path is a parameter and whose size bounds what is sent to the
executors. Each row is handled on its own: no shuffle. A null text is empty: no tokens, and the empty text is
decoded. Repeated rows give repeated results; other columns are not read, and an empty table gives an empty result. A very
long text is handled whole in its own task: pre-tokens one by one, a long one in n log n steps.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts_in

#: White space as the tokenizer's pattern means it (fixed by the format).
SPACE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-token pattern that byte-level vocabularies of this format are built with (fixed by the format).
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pre-tokens that a worker remembers, and the length up to which it does.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
#: Rows that a task encodes before it hands them on.
OUTPUT_ROWS = 256


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: printable Latin-1 stays, the others follow from 256 up, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tables:
    """What a tokenizer file holds, as bytes: small, picklable, the same on every executor."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or model["ignore_merges"]:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(raw(a), raw(b)): n for n, (a, b) in enumerate(merges)}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.specials.items()}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("ids", "specials", "ranks", "tokens")}

    def merge(self, piece: bytes) -> list[bytes]:
        """Apply the merges to one piece, lowest rank first, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks, never = self.ranks, len(self.ranks)
        if len(parts) > 48:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, at = never, -1
            for i in range(len(parts) - 1):
                r = ranks.get((parts[i], parts[i + 1]), never)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge_long(self, parts: list[bytes]) -> list[bytes]:
        """The same with a heap over a linked list, for pieces of any length in n log n."""
        import heapq

        n, ranks = len(parts), self.ranks
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, b""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p]

    def whole_tokens(self) -> set[str]:
        """Vocabulary strings that are one pre-token and whose merges end in exactly that one token."""
        pattern, found = regex.compile(PRE_TOKEN), set()
        for t in self.ids:
            try:
                s = t.decode()
            except UnicodeDecodeError:
                continue
            m = pattern.match(s)
            if m and m.end() == len(s) and self.merge(t) == [t]:
                found.add(s)
        return found

    @cached_property
    def joinable(self) -> set[bytes]:
        """Byte pairs that stand side by side inside some vocabulary token; between all others a cut is certain."""
        return {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}

    def fragments(self, piece: bytes) -> Iterator[bytes]:
        start, joinable = 0, self.joinable
        for i in range(1, len(piece)):
            if piece[i - 1 : i + 1] not in joinable:
                yield piece[start:i]
                start = i
        yield piece[start:]

    def split_specials(self, text: str) -> list[str]:
        """Ordinary and special strings in turn; special ones stand at odd places."""
        if not self.specials:
            return [text]
        longest_first = sorted(self.specials, key=len, reverse=True)
        return regex.split("(" + "|".join(map(regex.escape, longest_first)) + ")", text)


class Remembered(dict):
    """Answers by pre-token, computed when first asked, for a bounded number of short ones."""

    def __init__(self, answer, fixed=()):
        super().__init__(fixed)
        self.answer, self.room = answer, REMEMBERED

    def __missing__(self, piece: str):
        value = self.answer(piece)
        if self.room and len(piece) <= REMEMBERED_CHARS:
            self.room -= 1
            self[piece] = value
        return value


def token_counter(tables: Tables, whole: set[str]):
    """A function from a text to its number of tokens."""
    find = regex.compile(PRE_TOKEN).findall
    counts = Remembered(lambda p: len(tables.merge(p.encode())), dict.fromkeys(whole, 1))

    def count(text: str) -> int:
        parts = tables.split_specials(text)
        return len(parts) // 2 + sum(sum(map(counts.__getitem__, find(p))) for p in parts[::2])

    return count


def encoder(tables: Tables):
    """A function from a text to its ids, packed as little-endian 32-bit integers."""
    find = regex.compile(PRE_TOKEN).findall
    ids = tables.ids

    def encode_piece(piece: str) -> bytes:
        found = [ids[t] for f in tables.fragments(piece.encode()) for t in tables.merge(f)]
        return struct.pack(f"<{len(found)}I", *found)

    packed = Remembered(encode_piece)

    def encode(text: str) -> bytes:
        parts = tables.split_specials(text)
        out = []
        for i, p in enumerate(parts):
            out.append(struct.pack("<I", tables.specials[p]) if i % 2 else b"".join(map(packed.__getitem__, find(p))))
        return b"".join(out)

    return encode


def decoder(tables: Tables):
    """A function from packed ids to the text; bytes that are no UTF-8 become replacement characters."""
    last = max(tables.tokens)
    by_id = [tables.tokens.get(i, b"") for i in range(last + 1)]

    def decode(packed: bytes) -> str:
        return b"".join(map(by_id.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")

    return decode


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (columns doc_id and text)."""
    tables = Tables(path)
    shared = docs.sparkSession.sparkContext.broadcast((tables, tables.whole_tokens()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(*shared.value)
        for b in batches:
            texts = [t.as_py() or "" for t in b.column("text")]
            sizes, counts = [len(t.encode()) for t in texts], [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts_in(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def encode_decode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens and, for every row, ids and decoded_text; with ``digest`` their SHA-256 instead."""
    shared = docs.sparkSession.sparkContext.broadcast(Tables(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        encode, decode = encoder(tables), decoder(tables)
        for whole in batches:
            for b in (whole.slice(i, OUTPUT_ROWS) for i in range(0, whole.num_rows, OUTPUT_ROWS)):
                packed = [encode(t.as_py() or "") for t in b.column("text")]
                decoded = map(decode, packed)
                counts = pa.array([len(p) // 4 for p in packed], pa.int64())
                if digest:
                    cells = [[hashlib.sha256(p).hexdigest() for p in packed], [hashlib.sha256(d.encode()).hexdigest() for d in decoded]]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), counts, *map(pa.array, cells)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    ends = np.cumsum([0] + [len(p) // 4 for p in packed], dtype=np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), counts, ids, pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded_text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded_text string"
    return texts_in(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, {tail}")
