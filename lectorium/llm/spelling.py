"""Spelling variants: words that differ by one letter, each with its most frequent near word, found on bit-sliced positions.

Of two words that differ by one inserted, deleted or replaced letter, one half is intact: where the indexed word has
``size`` letters, its first ``size // 2`` begin the other word or the rest end it. So words meet in groups by length,
side and half. A group's words are sliced: for each position and letter a set of bits says which words have it there.
A query is walked letter by letter over these sets, for all words of the group at once; beside the words that agree so
far the walk keeps those with one error, at positions that are shifted by one where a letter is missing or extra. Pairs
whose first half is intact come from the first side only, all others from the second, so each pair comes once.

A group of more than ``GROUP`` words is dealt out in tiles, so no task holds a whole one. Words are counted in the
tasks before they are shuffled. Every word meets the words of its groups only; nothing is sent to all tasks.

Defined results: a null text has no words; a null id counts as an empty one where places of deleted letters are drawn.
Repeated rows count again. A very long text is counted in its own task, a very long word is compared like any other.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts_in

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One in so many runs of letters loses a letter before it is counted.
ONE_IN = 97
#: Words that a task counts before it hands them on.
HELD = 400_000
#: Indexed words of a group that a task holds, and queries for each of them; words sliced at a time.
GROUP, QUERIES_EACH, SLICE = 16_384, 4, 2_048
#: 64-bit words of bits per step of a walk.
TILE = 1 << 16


def count_words(docs: DataFrame, least_length: int = 5, least_times: int = 3) -> DataFrame:
    """word, n: words of at least so many letters, and their occurrences where they are at least so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                name = b"" if i is None else str(i).encode()
                start = zlib.crc32(name + b":")
                for word, n in Counter(RUN.findall((text or "").encode().lower().decode())).items():
                    if len(word) >= least_length:
                        h = zlib.crc32(word.encode(), start)
                        if h % ONE_IN == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                        total[word] += n
            if len(total) > HELD:
                yield rows()
                total.clear()
        yield rows()

    counted = texts_in(docs, "doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


class Slices:
    """Bit sets of words of one length by position and letter; the last set of each position is empty."""

    def __init__(self, words: np.ndarray, size: int):
        self.size, self.count = size, len(words)
        letters = words.view(np.uint32).reshape(self.count, size)
        self.alphabet = np.unique(letters)
        places = np.searchsorted(self.alphabet, letters)
        width = -(-self.count // 64)
        self.sets = np.zeros((size, len(self.alphabet) + 1, width), np.uint64)
        for p in range(size):
            bits = np.zeros((len(self.alphabet), width * 64), np.uint8)
            bits[places[:, p], np.arange(self.count)] = 1
            self.sets[p, :-1] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def near(self, queries: np.ndarray, length: int, first_side: bool) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of queries (all of one length) and of words that differ from them by one letter."""
        letters = queries.view(np.uint32).reshape(len(queries), length)
        places = np.searchsorted(self.alphabet, letters)
        known = self.alphabet[np.minimum(places, len(self.alphabet) - 1)] == letters
        places = np.where(known, places, len(self.alphabet))
        step, found = max(1, TILE // self.sets.shape[2]), []
        for i in range(0, len(queries), step):
            bits = self._walk(places[i : i + step], length, first_side)
            q, w = np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, : self.count])
            found.append((q + i, w))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))

    def _walk(self, places: np.ndarray, length: int, first_side: bool) -> np.ndarray:
        half, shift = self.size // 2, length - self.size
        agree = np.full((len(places), self.sets.shape[2]), ~np.uint64(0))  # no error so far
        wrong = np.zeros_like(agree)  # one error so far: one replaced, extra or missing letter
        intact = agree
        for i in range(length):
            here = self.sets[i][places[:, i]] if i < self.size else np.zeros_like(agree)
            if shift == 0:
                wrong = (wrong & here) | (agree & ~here)
            elif shift == 1:  # the query's letter is extra: from then on it stands one further than the word's
                wrong = (wrong & self.sets[i - 1][places[:, i]]) | agree if i else agree
            else:  # the word's letter is missing in the query
                wrong = (wrong | agree) & self.sets[i + 1][places[:, i]]
            agree = agree & here
            if i + 1 == half:
                intact = agree
        if shift == -1:
            wrong = wrong | agree  # the word's last letter is missing
        return wrong & (intact if first_side else ~intact)


def _postings(words: DataFrame, query: bool) -> DataFrame:
    """A word under its two halves; as a query under the halves that words of its length, one less and one more would share."""
    sizes = F.array(*[F.length("word") + d for d in ((-1, 0, 1) if query else (0,))])
    # names of their own: both sides of the later grouping come from one table
    of = words.select(F.col("word").alias("word"), F.col("n").alias("n"), F.explode(sizes).alias("size")).withColumn("half", F.floor(F.col("size") / 2).cast("int"))
    first = F.struct(F.lit(True).alias("first"), F.expr("substring(word, 1, half)").alias("part"))
    second = F.struct(F.lit(False).alias("first"), F.expr("right(word, size - half)").alias("part"))
    rows = of.select("word", "n", "size", F.explode(F.array(first, second)).alias("side"))
    return rows.select("word", "n", "size", "side.first", F.xxhash64("size", "side.first", "side.part").alias("key"))


def _match(index: pa.Table, queries: pa.Table) -> pa.Table:
    """For each query its near words' number and the best of them, group by group."""
    out: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}
    part = ["size", "first", "tile", "q_tile"]
    index, queries = index.sort_by([(c, "ascending") for c in [*part, "key"]]), queries.sort_by([(c, "ascending") for c in [*part, "key"]])

    def columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the parts begin, a number for each part, and keys."""
        cells = np.stack([table[c].to_numpy().astype(np.int64) for c in part], axis=1) if table.num_rows else np.zeros((0, 4), np.int64)
        return cells, table["key"].to_numpy(), np.array(table["word"].to_pylist(), object)

    (parts, keys, words), (q_parts, q_keys, q_words) = columns(index), columns(queries)
    times = index["n"].to_numpy()
    cuts = np.flatnonzero((np.diff(parts, axis=0) != 0).any(axis=1)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(parts)], strict=True):
        if a == b:
            continue
        mine = np.flatnonzero((q_parts == parts[a]).all(axis=1))
        size, first = int(parts[a, 0]), bool(parts[a, 1])
        begins = np.flatnonzero(np.concatenate([[True], np.diff(keys[a:b]) != 0])) + a  # of groups
        at = 0
        while at < len(begins):  # as many groups as fit into a slice; a larger one is a slice of its own
            stop = max(at + 1, int(np.searchsorted(begins, begins[at] + SLICE, "right")) - 1)
            lo, hi = begins[at], begins[stop] if stop < len(begins) else b
            asked = mine[np.searchsorted(q_keys[mine], keys[lo], "left") : np.searchsorted(q_keys[mine], keys[hi - 1], "right")]
            asked = asked[np.isin(q_keys[asked], keys[lo:hi])]
            if len(asked):
                own = words[lo:hi].astype(f"<U{size}")
                slices, order = Slices(own, size), np.argsort(np.argsort(own))
                lengths = np.array([len(w) for w in q_words[asked]])
                for length in range(size - 1, size + 2):
                    some = asked[lengths == length]
                    if len(some):
                        q, w = slices.near(q_words[some].astype(f"<U{length}"), length, first)
                        rank = np.lexsort((order[w], -times[lo:hi][w], q))
                        q, w = q[rank], w[rank]
                        heads = np.flatnonzero(np.concatenate([[True], np.diff(q) != 0])) if len(q) else np.zeros(0, int)
                        out["word"].extend(q_words[some][q[heads]])
                        out["n_near"].extend(np.diff([*heads, len(q)]).tolist())
                        out["best_n"].extend(times[lo:hi][w[heads]].tolist())
                        out["best"].extend(words[lo:hi][w[heads]])
            at = stop
    return pa.table({"word": pa.array(out["word"], pa.string()), "n_near": pa.array(out["n_near"], pa.int64()), "best_n": pa.array(out["best_n"], pa.int64()), "best": pa.array(out["best"], pa.string())})


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n_near, best, best_n for every word of a table (word, n) that has near words: their number, and the most frequent one."""
    index, queries = _postings(words, query=False), _postings(words, query=True)
    tiles = lambda df, most, name: df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name)).where(F.col(name) > 1)
    large = tiles(index, group, "tiles").join(tiles(queries, QUERIES_EACH * group, "q_tiles"), "key", "full")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("word"), one(c)).cast("int")
    index = index.join(large, "key", "left").select("word", "n", "size", "first", "key", own("tiles").alias("tile"), every("q_tiles").alias("q_tile"))
    queries = queries.join(large, "key", "left").select("word", "size", "first", "key", every("tiles").alias("tile"), own("q_tiles").alias("q_tile"))
    slots = max(1, -(-2 * words.count() // group))
    slot = F.pmod(F.xxhash64("key", "tile", "q_tile"), F.lit(slots)).alias("slot")
    met = index.select("*", slot).groupBy("slot").cogroup(queries.select("*", slot).groupBy("slot"))
    found = met.applyInArrow(_match, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.best", (-F.col("b.n")).alias("best_n"))


def follow(links: DataFrame) -> DataFrame:
    """word, root for links (word, form) without circles: the end of each chain, in as many rounds as its length has binary digits."""
    state = cut(links.select("word", F.col("form").alias("root")))
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = cut(state.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        state = nxt.select("word", "root")
        if not nxt.where("moved").limit(1).count():
            return state


def variants(docs: DataFrame, least_length: int = 5, least_times: int = 3, factor: int = 2, group: int = GROUP) -> DataFrame:
    """word, n, form, form_n, root, n_near for every counted word of ``docs`` (columns doc_id and text).

    A word's form is its near word of largest n, ties to the smaller word, if that n is ``factor`` times its own or
    more; its root is the last word that is reached from form to form.
    """
    words = cut(count_words(docs, least_length, least_times))
    found = words.join(near_words(words, group), "word", "left")
    has = F.col("best_n") >= factor * F.col("n")
    formed = cut(found.select("word", "n", F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")))
    roots = follow(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")
