"""Substring deduplication of word sequences with suffix automata.

Every window of 35 words that occurs twice or more is removed wherever it stands. The frame in ``repeats`` deals the
reference out to shards by anchor: a shard is a batch of whole anchor groups, so that windows that are equal meet
in one shard whatever texts they come from, and its size is bounded. A shard's suffix automaton counts how often each
state occurs; documents stream through the states that occur twice or more, and their matching statistics (the longest
suffix of what was read that is repeated) mark the maximal spans of at least 35 words.

The reference is the corpus itself and grows with it, so its automata are not broadcast: each is built in the task
to which its shard is dealt, and the documents' contexts come there with it. Overlapping contexts of one text are
joined before they enter the automaton, so no place in the corpus counts twice.

Defined results: null, blank and short texts hold no window and lose nothing; texts without words keep an empty text.
Very long texts are hashed in chunks, and only their contexts travel. Repeated rows, and rows of repeated or null ids, get
the result of their own text; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key, words_of
from .repeats import Window, distinct_texts, merged, repeated_spans

WORDS = Window(unit="word", length=35, gram=8, group_rows=4_000)
BATCH_ROWS = 1_500


class SuffixAutomaton:
    """Of several sequences; ``count`` says how often the strings of a state occur."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(0)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, sequence: list, times: int = 1) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)
            self.count[last] += times

    def finish(self) -> None:
        """Occurrences of a state include those of the states that link to it."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def matching_statistics(self, sequence: list, least: int = 2) -> Iterator[int]:
        """After each symbol, the length of the longest suffix read that occurs ``least`` times or more."""
        state = length = 0
        for c in sequence:
            while True:
                to = self.next[state].get(c)
                if to is not None and self.count[to] >= least:
                    state, length = to, length + 1
                    break
                if state == 0:
                    length = 0
                    break
                state = self.link[state]
                length = self.length[state]
            yield length


def engine(rows: list[tuple], w: Window) -> list[tuple[int, int, int, int, int]]:
    automaton, lone = SuffixAutomaton(), defaultdict(list)
    for _, alone, k1, k2, at, left, units in rows:
        words = units.split(b" ")
        if len(words) < w.length:
            continue
        if alone:
            lone[k1, k2].append((at - left, words))
        else:
            automaton.add(words, 2)
    segments = []
    for (k1, k2), pieces in lone.items():
        for start, words in sorted(pieces, key=lambda p: p[0]):
            if segments and segments[-1][:2] == (k1, k2) and start <= segments[-1][2] + len(segments[-1][3]):
                known = segments[-1][2] + len(segments[-1][3]) - start
                segments[-1][3].extend(words[max(known, 0) :])
            else:
                segments.append((k1, k2, start, list(words)))
    for s in segments:
        automaton.add(s[3])
    automaton.finish()
    out = []
    for k1, k2, start, words in segments:
        span = None
        for i, n in enumerate(automaton.matching_statistics(words)):
            if n >= w.length:
                if span and i - w.length + 1 <= span[1]:
                    span[1] = i + 1
                else:
                    if span:
                        out.append((k1, k2, start + span[0], start + span[1], w.length))
                    span = [i - w.length + 1, i + 1]
        if span:
            out.append((k1, k2, start + span[0], start + span[1], w.length))
    return out


def cut_words(docs: DataFrame, w: Window, digest: bool) -> DataFrame:
    """k1, k2 and what is left of every text that loses something."""
    texts = distinct_texts(docs, w)
    spans = repeated_spans(docs, texts, w, engine, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, left = [], []
            for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = text.encode().split()
                kept, at = [], 0
                for s, e in merged(found, len(words), w.length):
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                removed.append(len(words) - len(kept))
                joined = b" ".join(kept)
                left.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(removed, pa.int64()), pa.array(left, pa.string())], ["k1", "k2", "n_removed", "kept"])

    return texts.join(spans, ["k1", "k2"]).select("k1", "k2", "text", "spans").mapInArrow(run, "k1 long, k2 long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, w: Window = WORDS, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (words joined by one space) or, with ``digest``, kept_sha256.

    A null text has no words; repeated rows are each other's repeats; an empty table gives an empty result; other
    columns are not read.
    """
    words = words_of(F.col("text"))
    joined = F.array_join("words", " ")
    name = "kept_sha256" if digest else "kept_text"
    thin = docs.select("doc_id", *text_key(F.col("text")), words.alias("words")).select(
        "doc_id", "k1", "k2", F.size("words").cast("long").alias("n_words"), (F.sha2(joined, 256) if digest else joined).alias("whole")
    )
    cuts = cut_words(docs, w, digest)
    return thin.join(cuts, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "whole").alias(name)
    )
