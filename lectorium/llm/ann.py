"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one full-dimensional word from each of several codebooks. The books are fitted one
after another to the residuals of a bounded sample; every row is then encoded by beam search, which keeps the best
partial sums, and stored with its codes and the factor by which its norm exceeds that of its reconstruction. The rows
lie in lanes of bounded size. A query scores a lane from a table of its inner products with all words, times the
stored factors, takes the best share of the lane and ranks that exactly, in double precision, on the original vectors;
the best of all lanes are the answer. Since the share is one of each lane, recall does not fall as the table grows.

The queries are a stated set, so work is queries times rows. Queries lie in full blocks, and each pair of a block and a
lane is a group that Spark deals out: a row travels once for each block of queries (16,384, or 328,000 rows' worth), a
query once for each lane. Nothing grows in a task, and only the fitted books are sent to all.

Defined results: vectors that are null, zero, of another width than most or hold null or non-finite components take no
part, neither as queries nor as candidates; rows without an id neither. Ties in score go to the smaller id, and rows
that repeat an id are candidates each; as queries they give one answer, the best of either. Other columns are not read. An empty table, or one without a query, gives an
empty result; a table of fewer rows than k gives all of them. There are no texts here, so none can be long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Quantiser:
    """Parameters. The sample that books are fitted on is bounded by ``sample`` rows; everything else covers all rows."""

    books: int = 24
    words: int = 128
    sample: int = 8_000
    rounds: int = 8
    beam: int = 4
    lane: int = 8_192  # rows that meet a block of queries in one task
    query_block: int = 16_384
    tile: int = 256  # queries scored at a time
    share: float = 0.02  # of a lane that is ranked exactly
    least: int = 64
    seed: int = 11


def usable(table: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles, where it can take part; all of one width."""
    v = F.col("embedding").cast("array<double>")
    good = table.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    good = good.where(F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    width = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    return good.join(F.broadcast(width), F.size("v") == F.col("d"), "left_semi")


def nearest_word(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(1) - 2 * x @ book.T, axis=1)


def fit_books(x: np.ndarray, q: Quantiser) -> np.ndarray:
    """[books, words, dim]: k-means on the residuals left by the books before."""
    rng = np.random.default_rng(q.seed)
    rest, books = x.astype(np.float32), []
    for _ in range(q.books):
        book = rest[rng.choice(len(rest), q.words, replace=len(rest) < q.words)].copy()
        for _ in range(q.rounds):
            own = nearest_word(rest, book)
            counts = np.bincount(own, minlength=q.words)
            sums = np.zeros_like(book)
            np.add.at(sums, own, rest)
            book = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], rest[rng.integers(len(rest), size=q.words)])
        rest = rest - book[nearest_word(rest, book)]
        books.append(book)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes [n, books] and squared norms of the reconstructions, by beam search over the books in turn."""
    x = x.astype(np.float32)
    n, m = len(x), len(books)
    codes = np.zeros((n, 1, 0), np.uint8)
    rests, errors = x[:, None, :], (x**2).sum(1)[:, None]
    for book in books:
        width = rests.shape[1]
        gain = (book**2).sum(1) - 2 * rests @ book.T  # [n, width, words]
        total = (errors[:, :, None] + gain).reshape(n, -1)
        keep = min(beam, total.shape[1])
        best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
        parent, word = best // len(book), best % len(book)
        rows = np.arange(n)[:, None]
        rests = rests[rows, parent] - book[word]
        errors = np.take_along_axis(total, best, 1)
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
    first = np.argmin(errors, axis=1)
    chosen = codes[np.arange(n), first]
    made = sum(books[i][chosen[:, i]] for i in range(m)) if n else np.zeros_like(x)
    return chosen, (made**2).sum(1)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, dim)


def build_index(table: DataFrame, q: Quantiser = Quantiser()) -> tuple[DataFrame, np.ndarray]:
    """The index, one row per vector (vec_id, v, codes, factor), and the books."""
    vectors = cut(usable(table).where("vec_id is not null"))
    # a bounded sample: the rows whose hashed ids are smallest
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(q.sample).select("v").toArrow()["v"].combine_chunks()
    dim = len(sample[0]) if len(sample) else 1
    books = fit_books(matrix(sample, dim), q) if len(sample) else np.zeros((q.books, q.words, 1), np.float32)
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), dim)
            codes, norms = encode(x, sent.value, q.beam)
            factor = np.sqrt((x**2).sum(1) / np.maximum(norms, 1e-12))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factor)], ["vec_id", "v", "codes", "factor"]
            )

    return cut(vectors.mapInArrow(run, "vec_id long, v array<double>, codes binary, factor double")), books


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, first, 1), np.take_along_axis(scores, first, 1)


def search_lane(q_ids: np.ndarray, y: np.ndarray, rows: pa.Table, books: np.ndarray, k: int, q: Quantiser) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best rows of a lane for a few queries; -inf where there are fewer."""
    ids, x = rows["vec_id"].to_numpy(), matrix(rows["v"], y.shape[1])
    codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(ids), -1).T
    tables = [y.astype(np.float32) @ book.T for book in books]
    guess = sum(t[:, c] for t, c in zip(tables, codes, strict=True)) * rows["factor"].to_numpy().astype(np.float32)
    many = min(len(ids), max(q.least, k + 1, int(q.share * len(ids))))
    near = np.argpartition(-guess, many - 1, axis=1)[:, :many]
    exact = np.stack([x[n] @ v for n, v in zip(near, y, strict=True)])
    exact[ids[near] == q_ids[:, None]] = -np.inf
    return top(ids[near], exact, k)


def search(table: DataFrame, every: int = 20, k: int = 20, q: Quantiser = Quantiser()) -> DataFrame:
    """query_id, rank, vec_id, score: the k best by inner product for every row whose id is divisible by ``every``."""
    index, books = build_index(table, q)
    dim, sent = books.shape[2], table.sparkSession.sparkContext.broadcast(books)
    asked = index.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    lanes = max(1, -(-index.count() // q.lane))
    blocks = max(1, -(-asked.count() // q.query_block))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = index.select(every_of(blocks).alias("block"), deal(lanes, "lane").alias("lane"), "vec_id", "v", "codes", "factor")
    asked = asked.select(deal(blocks, "block").alias("block"), every_of(lanes).alias("lane"), "vec_id", "v")

    def meet(queries: pa.Table, own: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = []
        for i in range(0, len(queries) if len(own) else 0, q.tile):
            part = queries.slice(i, q.tile)
            q_ids = part["vec_id"].to_numpy()
            ids, scores = search_lane(q_ids, matrix(part["v"], dim), own, sent.value, k, q)
            real = scores > -np.inf
            found.append([np.broadcast_to(q_ids[:, None], ids.shape)[real], ids[real], scores[real]])
        cells = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cells, strict=True)))

    key = ["block", "lane"]
    found = asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
