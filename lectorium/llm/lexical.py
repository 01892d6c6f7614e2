"""Ranked lexical search: summed accumulators of short lists, walked document by document with skips over long ones.

Documents stay where they lie. A first pass keeps of every document its number of terms and how often it holds each
term that some item asks for; document frequencies and totals are counted from that. In a second pass each task scores
its documents in shards. Of an item's terms those with short lists in the shard are added up term by term into
accumulators, which then count as one list with a bound of its own. Together with the long lists it is walked in order
of documents: blocks whose bounds cannot reach the item's tenth best score are skipped, in the others only documents
that still can are looked up in the long lists, the strongest list first. A task carries the scores to beat from shard
to shard and hands on k documents an item; the best of all tasks are the answer, whatever the partitioning.

What is sent to the tasks are the items' terms, ``MOST_TERMS`` rows at a time; more items take further rounds.

Defined results: null and blank texts have no terms and are never found; a null id is an id that comes last among equal
scores. Rows that repeat a document's id are documents each. Items that share an id (null is one too) are one item with
the terms of all; an item without a term that some document holds gives no row. A very long text is one document whose
terms are counted in its own task. Other columns are not read. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, texts_in

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A byte of a UTF-8 text as part of a term, or a space.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Rows (item, term) that are sent to the tasks at a time.
MOST_TERMS = 400_000
#: Documents of a shard at least, postings of one at most before it is closed, documents of a block.
SHARD, POSTINGS, BLOCK = 16_384, 2_000_000, 128
#: A list is short if it holds at most one in so many documents of the shard.
SPARSE = 16
#: Groups in which the tasks' best documents of an item are thinned before they meet.
SALTS = 16


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Request:
    """Items by number, with their terms by number, and what the corpus says of the terms."""

    item_ids: list
    terms: list[np.ndarray]
    weights: np.ndarray
    n_docs: int
    n_terms: int


class Shard:
    """Postings of some documents: by term, in order of documents, with the score that each adds."""

    def __init__(self, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tf: np.ndarray, request: Request):
        self.size = len(n)
        m = 10 + 90 * n.astype(np.int64) * request.n_docs // max(1, request.n_terms)
        docs = np.repeat(np.arange(self.size), counts)
        order = np.argsort(terms, kind="stable")
        terms, self.docs, tf = terms[order], docs[order], tf[order].astype(np.int64)
        self.adds = request.weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs]))
        self.starts = np.searchsorted(terms, np.arange(len(request.weights) + 1))
        self.blocks = -(-self.size // BLOCK)
        self._bounds: dict[int, np.ndarray] = {}

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[t], self.starts[t + 1])
        return self.docs[at], self.adds[at]

    def block_most(self, docs: np.ndarray, adds: np.ndarray) -> np.ndarray:
        most = np.zeros(self.blocks, np.int64)
        np.maximum.at(most, docs // BLOCK, adds)
        return most

    def bounds(self, t: int) -> np.ndarray:
        if t not in self._bounds:
            self._bounds[t] = self.block_most(*self.postings(t))
        return self._bounds[t]

    def accumulators(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Documents of short lists, in order, with the sums of what the lists add (term by term)."""
        sums = np.zeros(self.size, np.int64)
        for t in terms:
            docs, adds = self.postings(t)
            sums[docs] += adds  # a list has a document once
        found = np.flatnonzero(sums)
        return found, sums[found]

    def best(self, terms: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that score at least ``floor`` (or the k-th best so far), their scores, and documents scored in full."""
        sizes = self.starts[terms + 1] - self.starts[terms]
        short = [t for t, s in zip(terms.tolist(), sizes, strict=True) if 0 < s <= self.size // SPARSE]
        long = sorted((t for t, s in zip(terms.tolist(), sizes, strict=True) if s > self.size // SPARSE), key=lambda t: -int(self.bounds(t).max()))
        docs, sums = self.accumulators(short)
        ends = np.searchsorted(docs, np.arange(self.blocks + 1) * BLOCK)
        tails = np.zeros((len(long) + 1, self.blocks), np.int64)  # what the lists from the i-th on can add
        for i in range(len(long) - 1, -1, -1):
            tails[i] = tails[i + 1] + self.bounds(long[i])
        bound = self.block_most(docs, sums) + tails[0]
        lists = [self.postings(t) for t in long]
        found, scores, top, scored = [], [], np.zeros(0, np.int64), 0
        floor = max(1, floor)
        for b in np.flatnonzero(bound >= floor):
            if bound[b] < floor:
                continue  # the k-th best score has risen since
            own = slice(ends[b], ends[b + 1])
            if tails[0, b] >= floor:
                at = np.arange(b * BLOCK, min(self.size, (b + 1) * BLOCK))
                score = np.zeros(len(at), np.int64)
                score[docs[own] - b * BLOCK] = sums[own]
            else:  # the long lists alone do not reach the score: only documents with an accumulator can
                at, score = docs[own], sums[own].copy()
            for i, (where, adds) in enumerate(lists):
                able = score + tails[i, b] >= floor
                at, score = at[able], score[able]
                if not len(at):
                    break
                place = np.searchsorted(where, at)
                place[place == len(where)] = 0
                score += np.where(where[place] == at, adds[place], 0)
            good = score >= floor
            scored += len(at)
            if good.any():
                found.append(at[good])
                scores.append(score[good])
                top = np.sort(np.concatenate([top, score[good]]))[-k:]
                if len(top) == k:
                    floor = max(floor, int(top[0]))
        none = np.zeros(0, np.int64)
        return (np.concatenate(found), np.concatenate(scores), scored) if found else (none, none, scored)


def _count(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tf: a document's number of terms, and those of the vocabulary with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for b in batches:
            sizes, counts, terms, tf = [], [0], [], []
            for text in b.column("text").to_pylist():
                words = (text or "").encode().translate(BYTES).split()
                found = Counter(map(number, words))
                found.pop(None, None)
                sizes.append(len(words))
                counts.append(counts[-1] + len(found))
                terms.extend(found.keys())
                tf.extend(found.values())
            ends = pa.array(counts, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts_in(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tf array<long>")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, postings = [], 0, 0
    for b in batches:
        held.append(b)
        rows, postings = rows + b.num_rows, postings + len(b.column("terms").flatten())
        if rows >= SHARD or postings >= POSTINGS:
            yield pa.Table.from_batches(held)
            held, rows, postings = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def _search(counted: DataFrame, request: Request, k: int, kinds: str) -> DataFrame:
    shared = counted.sparkSession.sparkContext.broadcast(request)
    key = lambda hit: (-hit[0], hit[1] is None, hit[1] if hit[1] is not None else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best: list[list] = [[] for _ in asked.terms]
        for table in _shards(batches):
            terms, ids = table["terms"].combine_chunks(), table["doc_id"]
            shard = Shard(table["n"].to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), table["tf"].combine_chunks().flatten().to_numpy(), asked)
            for i, own in enumerate(asked.terms):
                docs, scores, _ = shard.best(own, best[i][-1][0] if len(best[i]) == k else 0, k)
                if len(docs):
                    best[i] = sorted([*best[i], *zip(scores.tolist(), ids.take(pa.array(docs)).to_pylist(), strict=True)], key=key)[:k]
        rows = [(n, *hit) for n, hits in enumerate(best) for hit in hits]
        if rows:
            numbers, scores, ids = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(ids, counted_kind), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    counted_kind = pa.schema([("doc_id", _arrow_type(counted, "doc_id"))]).field("doc_id").type
    return counted.mapInArrow(run, f"item int, doc_id {kinds}, score long")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, most_terms: int = MOST_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of every item (item_id, text)."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    asked = cut(items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct())
    rounds = max(1, -(-asked.count() // most_terms))
    found = None
    for r in range(rounds):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r)
        own = _one_round(docs, mine, k, kind)
        found = own if found is None else found.union(own)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    thinned = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    for group in (["item_id", "salt"], ["item_id"]):
        thinned = thinned.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
    return thinned.select("item_id", "rank", "doc_id", "score")


def _one_round(docs: DataFrame, asked: DataFrame, k: int, kind: str) -> DataFrame:
    """The tasks' best documents of items whose terms are few enough to be sent."""
    spark = docs.sparkSession
    rows = asked.toArrow()
    names = rows["term"].combine_chunks().dictionary_encode()
    numbers = dict.fromkeys(rows["item_id"].to_pylist())  # items in order of appearance
    ids = {x: i for i, x in enumerate(numbers)}
    counted = cut(_count(docs, {t.encode(): i for i, t in enumerate(names.dictionary.to_pylist())}))
    totals = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    seen = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()  # a row for each term sent
    weights = np.zeros(len(names.dictionary), np.int64)
    for term, df in seen:
        weights[term] = weight(totals.n_docs, df)
    own: list[list[int]] = [[] for _ in ids]
    for item, term in zip(rows["item_id"].to_pylist(), names.indices.to_pylist(), strict=True):
        if weights[term] > 0:
            own[ids[item]].append(term)
    request = Request(list(ids), [np.array(sorted(x), np.int64) for x in own], weights, totals.n_docs, totals.n_terms)
    hits = _search(counted, request, k, kind)
    schema = f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}"
    named = spark.createDataFrame(list(enumerate(request.item_ids)), schema)
    return hits.join(F.broadcast(named), "item").select("item_id", "doc_id", "score")  # no more items than terms sent


#: The same with every pair of an item and a document that share a term.
SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
tot AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS t FROM benchmark),
post AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
wanted AS (SELECT * FROM post WHERE t IN (SELECT t FROM asked)),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM wanted, tot GROUP BY t, n_docs),
sizes AS (SELECT r, doc_id, 100 - 90 + 90 * len(w) * n_docs // n_terms AS m FROM d, tot WHERE len(w) > 0),
scores AS (SELECT item_id, r, doc_id, CAST(sum(w * (1000000000 * tf // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (t) JOIN wanted USING (t) JOIN sizes USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10"""
