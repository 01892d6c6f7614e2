"""Suffix-array deduplication of byte strings by merging Burrows-Wheeler columns.

Every repeated string of 400 bytes is removed wherever it stands. The frame in ``repeats`` brings together the
texts that share an anchor. Here each text is a shard; its suffixes, aligned on the anchor, have the preceding byte
as their Burrows-Wheeler symbol. The merge of all shards starts as one interleave in which no suffix is told from
another and refines it one byte at a time, from the right: a stable partition of the current order by the next
symbol. Longest common prefixes of neighbours follow from those of the pass before (one more where the symbols agree,
by a range minimum over what stood between them, else none), so suffixes are never sorted again. Where a suffix
shares 400 bytes with a neighbour, the interval is repeated.

All groups of a batch are refined together, column by column, in numpy. Common prefixes are known to any length, so
one merge tells both the strings that are removed and shorter ones that are only counted.

Defined results: a null or empty text holds nothing; rows with equal texts are each other's repeats; very long texts
are hashed in chunks and cut in one piece; of strings that overlap every byte goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key
from .repeats import Window, distinct_texts, merged, repeated_spans

#: Strings of 400 bytes are removed. Passages of over 50 words are often shorter, so those of 200 are counted as well.
BYTES = Window(unit="byte", length=200, gram=32, group_rows=50_000, longest=400)  # a task's matrix: 80 MB at most
#: For a pipeline: passages of 50 words of three letters and more are removed.
PASSAGES = Window(unit="byte", length=200, gram=32, group_rows=50_000)
BATCH_ROWS = 6_000


def range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Smallest of values[first..last] for each pair, from a table of minima over power-of-two lengths."""
    span = last - first + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out, table = np.empty(len(first), values.dtype), values
    for j in range(int(level.max()) + 1):
        here = np.flatnonzero(level == j)
        if len(here):
            out[here] = np.minimum(table[first[here]], table[last[here] - (1 << j) + 1])
        if len(table) > 1 << j:
            table = np.minimum(table[: -(1 << j)], table[1 << j :])
    return out


def refine_interleave(columns: np.ndarray, group: np.ndarray, lengths: tuple[int, ...], left: int) -> list[np.ndarray]:
    """Which aligned suffixes share so many symbols with another of their group, for each of ``lengths``.

    columns[c, r]: symbol c of row r, 0 outside its text (never equal to anything). group: ascending numbers of the
    rows' groups. Gives arrays [c, r] for c up to ``left``.
    """
    width, rows = columns.shape
    order, lcp = np.arange(rows), np.zeros(rows, np.int32)
    repeated = [np.zeros((left + 1, rows), bool) for _ in lengths]
    for c in range(width - 1, -1, -1):
        symbol = columns[c][order].astype(np.int64)
        key = group[order] * 512 + symbol
        step = np.diff(key)
        if (step >= 0).all():  # the next symbol leaves the order as it is
            lcp[1:] = np.where((step == 0) & (symbol[1:] > 0), lcp[1:] + 1, 0)
        else:
            moved = np.argsort(key, kind="stable")
            key = key[moved]
            same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[moved[1:]] > 0))
            fresh = np.zeros(rows, np.int32)
            if len(same):
                fresh[same + 1] = range_min(lcp, moved[same] + 1, moved[same + 1]) + 1
            order, lcp = order[moved], fresh
        for length, found in zip(lengths, repeated, strict=True) if c <= left else ():
            shared = lcp >= length
            shared[:-1] |= shared[1:]
            found[c, order] = shared
    return repeated


def engine(rows: list[tuple], w: Window) -> list[tuple[int, int, int, int, int]]:
    grams = np.array([r[0] for r in rows], np.int64)
    group = np.cumsum(np.diff(grams, prepend=grams[0]) != 0)
    columns = np.zeros((len(rows), w.left + w.reach), np.uint16)
    for i, r in enumerate(rows):
        offset = w.left - r[5]
        columns[i, offset : offset + len(r[6])] = np.frombuffer(r[6], np.uint8)
        columns[i, offset : offset + len(r[6])] += 1
    out = []
    for length, repeated in zip(w.lengths, refine_interleave(np.ascontiguousarray(columns.T), group, w.lengths, w.left), strict=True):
        edges = np.diff(repeated.T.astype(np.int8), axis=1, prepend=0, append=0)
        (i, first), (_, last) = np.nonzero(edges == 1), np.nonzero(edges == -1)  # last: one past the last start
        for i, first, last in zip(i.tolist(), first.tolist(), last.tolist(), strict=True):
            _, lone, k1, k2, at, _, _ = rows[i]
            if lone:
                out.append((k1, k2, at - w.left + first, at - w.left + last - 1 + length, length))
    return out


def cut_bytes(docs: DataFrame, w: Window, digest: bool) -> DataFrame:
    """k1, k2 and what is left, without strings of the window's longest length, of every text that repeats some."""
    texts = distinct_texts(docs, w)
    spans = repeated_spans(docs, texts, w, engine, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, repeated, counts, left = [], [], [], []
            for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                ranges = merged(found, len(raw), w.reach)
                kept, at = [], 0
                for s, e in ranges:
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                removed.append(len(raw) - len(kept))
                repeated.append(sum(e - s for s, e in merged(found, len(raw), w.length)))
                counts.append(len(ranges))
                left.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "ignore"))
            cells = [pa.array(x, pa.int64()) for x in (removed, repeated, counts)]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), *cells, pa.array(left, pa.string())], ["k1", "k2", "n_removed", "n_repeated", "n_spans", "kept"])

    return texts.join(spans, ["k1", "k2"]).select("k1", "k2", "text", "spans").mapInArrow(
        run, "k1 long, k2 long, n_removed long, n_repeated long, n_spans long, kept string"
    )


def remove_repeats(docs: DataFrame, w: Window = BYTES) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``; adds n_removed and n_spans.

    A cut may split a character of several bytes; what is left of it is dropped from the text. A null text is
    empty and stays null; an empty table stays empty; n_removed and n_spans of the input are replaced.
    """
    rest = [c for c in docs.columns if c not in ("n_removed", "n_spans")]
    cuts = cut_bytes(docs, w, digest=False).drop("n_repeated").toDF("__k1", "__k2", "__removed", "__spans", "__kept")
    keys = [k.alias(n) for k, n in zip(text_key(F.col("text")), ("__k1", "__k2"), strict=True)]
    joined = docs.select(*[F.col(f"`{c}`") for c in rest], *keys).join(cuts, ["__k1", "__k2"], "left")
    return joined.select(
        *[F.coalesce("__kept", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in rest],
        F.coalesce("__removed", F.lit(0)).alias("n_removed"),
        F.coalesce("__spans", F.lit(0)).alias("n_spans"),
    )


def removal_digest(docs: DataFrame, w: Window = BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and n_repeated, for every row.

    n_repeated: bytes covered by strings of the window's shorter length that stand elsewhere too; these stay.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select("doc_id", *text_key(F.col("text")), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    cuts = cut_bytes(docs, w, digest=True)
    return thin.join(cuts, ["k1", "k2"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept", "whole").alias("kept_sha256"),
        F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"),
    )
