"""License scans: winnowed fingerprints pick candidate templates, banded alignment reports coverage and spans.

Templates (a fixed, small set, or one given as a parameter with a checked size) are split into folded words. Hashes of
their k-word shingles are winnowed (the smallest of every few neighbours) into an inverted index from fingerprint to
(template, place). A document's winnowed fingerprints vote, by template, for a diagonal: the distance between the
place in the document and in the template. Around every diagonal with enough votes, a band of the alignment matrix of
template and document words is filled (words match or are skipped on either side); the matched words give coverage
of the template and the span in the document. The votes that are asked for grow with the template (``share`` of its
fingerprints), so a sentence that a long license has in common with others is no candidate. Where passages were put in
or left out, a copy lies on several diagonals of which none reaches the coverage: those near each other are chained, the
longest sequence of their matched words that rises in both texts. Templates that are shorter than a shingle
and a window together are indexed by every shingle and must match whole.

``TEMPLATES`` holds notices; ``read_templates`` takes full license texts from a folder.

One row per document and matched template; a document without one has a single row with a null template. A null or
empty text matches nothing. Repeated rows give repeated results; other columns are not read, and an empty table gives
an empty result. Each row is handled on its own, without a shuffle; long texts cost in proportion to their length and
their votes.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts_in

#: Public license notices as they stand in files.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT header": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


@dataclass(frozen=True)
class Scan:
    """Parameters: words in a shingle, shingles in a window, votes for a diagonal (at least so many, and this share of the
    template's fingerprints), half width of the band in words, smallest matched share of a template in percent, words that
    may lie between two parts of a copy, and the most template words that are sent to the executors."""

    shingle: int = 3
    window: int = 4
    votes: int = 1
    share: float = 0.03
    band: int = 8
    coverage: int = 80
    gap: int = 400
    most_words: int = 1_000_000


def folded(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(m.group().lower(), m.span()) for m in WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def shingles(words: list[str], s: Scan) -> list[int]:
    return [xxhash.xxh64_intdigest(" ".join(words[i : i + s.shingle])) for i in range(len(words) - s.shingle + 1)]


def chosen(hashes: list[int], i: int, s: Scan) -> bool:
    """Whether a shingle is the smallest, the rightmost of equals, of some window that it stands in."""
    if len(hashes) <= s.window:
        return True
    starts = range(max(0, i - s.window + 1), min(i, len(hashes) - s.window) + 1)
    return any(min(range(k, k + s.window), key=lambda j: (hashes[j], -j)) == i for k in starts)


def rising(pairs: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest sequence of pairs in which both numbers rise."""
    ordered = sorted(pairs, key=lambda p: (p[0], -p[1]))
    ends: list[int] = []  # of the shortest ends, by length: places in ``ordered``
    lasts: list[int] = []
    before = [-1] * len(ordered)
    for n, (_, j) in enumerate(ordered):
        k = bisect.bisect_left(lasts, j)
        before[n] = ends[k - 1] if k else -1
        ends[k : k + 1], lasts[k : k + 1] = [n], [j]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(ordered[n])
        n = before[n]
    return out[::-1]


class Index:
    """The templates' words and the postings of their fingerprints."""

    def __init__(self, templates: dict[str, str], s: Scan):
        self.s, self.names = s, sorted(templates)
        self.words = [folded(templates[n])[0] for n in self.names]
        if sum(map(len, self.words)) > s.most_words:
            raise ValueError("too many template words to send to every executor")
        self.postings = defaultdict(list)
        self.short = [len(w) < s.shingle + s.window for w in self.words]
        self.votes = []
        for t, words in enumerate(self.words):
            hashes = shingles(words, s)
            own = [i for i in range(len(hashes)) if self.short[t] or chosen(hashes, i, s)]
            self.votes.append(max(s.votes, math.ceil(s.share * len(own))))
            for i in own:
                self.postings[hashes[i]].append((t, i))

    def candidates(self, words: list[str]) -> dict[int, list[int]]:
        """Diagonals that have enough votes within half a band, by template, at least half a band apart."""
        votes: dict[tuple[int, int], int] = defaultdict(int)
        hashes = shingles(words, self.s)
        for i, h in enumerate(hashes):
            if met := self.postings.get(h):
                mine = chosen(hashes, i, self.s)  # asked for the few shingles only that some template has
                for t, j in met:
                    if self.short[t] or mine:
                        votes[t, i - j] += 1
        found: dict[int, list[int]] = defaultdict(list)
        ordered, half = sorted(votes.items()), self.s.band // 2
        ahead, near = 0, 0  # votes of the same template up to half a band further
        for at, ((t, d), n) in enumerate(ordered):
            if ahead <= at:
                ahead, near = at, 0
            while ahead < len(ordered) and ordered[ahead][0][0] == t and ordered[ahead][0][1] <= d + half:
                near += ordered[ahead][1]
                ahead += 1
            if near >= self.votes[t] and not (found[t] and d - found[t][-1] <= half):
                found[t].append(d)
            near -= n
        return found

    def align(self, words: list[str], t: int, diagonal: int) -> list[tuple[int, int]]:
        """Matched (template, document) places of a longest common subsequence inside the band."""
        own, half = self.words[t], self.s.band
        width = 2 * half + 1
        lengths = [[0] * (width + 2) for _ in range(len(own) + 1)]
        for i in range(1, len(own) + 1):
            row, above = lengths[i], lengths[i - 1]
            for b in range(1, width + 1):
                j = i - 1 + diagonal + b - 1 - half  # the document's word of this cell
                best = max(above[b + 1], row[b - 1])
                if 0 <= j < len(words) and words[j] == own[i - 1]:
                    best = max(best, above[b] + 1)
                row[b] = best
        pairs, i, b = [], len(own), width
        while i and b:
            j = i - 1 + diagonal + b - 1 - half
            here = lengths[i][b]
            if here == lengths[i][b - 1]:
                b -= 1
            elif b < width + 1 and here == lengths[i - 1][b + 1]:
                i, b = i - 1, b + 1
            else:
                pairs.append((i - 1, j))
                i -= 1
        return pairs[::-1]

    def chains(self, t: int, parts: list[tuple[int, list[tuple[int, int]]]]) -> Iterator[list[tuple[int, int]]]:
        """Of parts on diagonals near each other, the longest sequence of pairs that rises in both places."""
        gap, at = min(self.s.gap, len(self.words[t]) // 2), 0
        while at < len(parts):
            end = at + 1
            while end < len(parts) and parts[end][0] - parts[end - 1][0] <= gap:
                end += 1
            if end - at > 1:
                yield rising({p for _, pairs in parts[at:end] for p in pairs})
            at = end

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, start, end) of every match that reaches the least coverage; the
        character span runs from the first matched word to the last. Overlapping matches of a template: the best."""
        words, places = folded(text)
        out = []
        for t, diagonals in self.candidates(words).items():
            least = (100 if self.short[t] else self.s.coverage) * len(self.words[t])
            matches, parts = [], []
            for d in diagonals:
                pairs = self.align(words, t, d)
                if 100 * len(pairs) >= least:
                    matches.append((len(pairs), -pairs[0][1], pairs[-1][1]))
                elif pairs:
                    parts.append((d, pairs))
            for pairs in self.chains(t, parts):
                if 100 * len(pairs) >= least:
                    matches.append((len(pairs), -pairs[0][1], pairs[-1][1]))
            taken: list[tuple[int, int]] = []
            for n, first, last in sorted(matches, reverse=True):
                if all(last < a or -first > z for a, z in taken):
                    taken.append((-first, last))
                    out.append((self.names[t], n / len(self.words[t]), n, places[-first][0], places[last][1]))
        return sorted(out, key=lambda m: (m[3], m[0]))


def read_templates(spark: SparkSession, folder: str, s: Scan = Scan()) -> dict[str, str]:
    """Full texts by file name; refused where they are more than may be sent to every executor."""
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    if files.agg(F.sum(F.size(F.split("value", r"\s+")))).first()[0] > s.most_words:
        raise ValueError("too many template words to send to every executor")
    return {r.name: r.value for r in files.collect()}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, s: Scan = Scan()) -> DataFrame:
    """doc_id, template, coverage, matched_words, span_start, span_end (characters, end exclusive)."""
    sent = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column("text")):
                found = index.scan(text.as_py() or "") or [(None, None, None, None, None)]
                at += [i] * len(found)
                rows += found
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            cells = [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *cells], ["doc_id", "template", "coverage", "matched_words", "span_start", "span_end"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts_in(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, template string, coverage double, matched_words long, span_start long, span_end long")
