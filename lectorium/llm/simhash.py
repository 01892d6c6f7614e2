"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A text's 64-bit fingerprint takes a bit where more than half of the hashes of its 3-word shingles have it. Two
fingerprints link at two or fewer differing bits, so of their eight bytes at least six agree by position. The
index posts every distinct fingerprint under pairs of 16-bit blocks: of four blocks a linked pair shares two at
least, hence one posting. Within a posting the shared positional bytes of each pair are tallied, pairs with fewer
than six are dropped and the rest verified. A posting with more members than ``POSTING`` is not paired up: its
members go through the words one bit away instead. Fingerprints that share such a word are linked and linked
fingerprints share one, so a star around the smallest member of each word (65 members at most) links the same
components at linear cost.

With a ``similarity`` (``similar_groups``) texts link when their fingerprints differ in ``distance`` bits at most, up to
seven, and the sets of their shingles have that Jaccard similarity. Of four 16-bit blocks one then differs in one bit
at most, so a text is posted under its blocks and under each with one of its ones cleared. As closeness alone no longer
links, crowds are thinned, not starred: texts are first held against leaders of runs of ``POSTING`` near fingerprints,
and what these links join is one group; then every pair of different groups that meets in a posting is held against
the rule, so the components are those of all pairs.

Defined results: null, empty and blank texts have fingerprint zero and link like any other. Rows with equal texts
share a fingerprint, so copies are never paired. A null id takes part but is never the smallest; a component of
null ids only has a null id. Other columns are not read. A very long text is hashed in chunks of ``CHUNK`` shingles; for a
similarity the shingles of the two texts of a pair are held. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_key, texts_in

SEED, BITS, WIDTH, DISTANCE, SHARED_BYTES = 42, 64, 3, 2, 6
#: Largest distance at which one 16-bit block in four surely differs in one bit at most (and one byte in eight in none).
FARTHEST = 7
#: Members up to which a posting is paired up.
POSTING = 64
#: Shingles hashed at a time: bounds the memory of very long texts.
CHUNK = 1 << 15
#: Comparisons of fingerprints made at a time.
TILE = 1 << 20


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """A hash of every run of ``width`` words; of the whole text if it has fewer."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only the six ASCII spaces separate
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)] if words else []
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """As a signed 64-bit integer."""
    h = shingle_hashes(text, width)
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([fingerprint(t.as_py()) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), prints], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts_in(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of shingle hashes; 1 if both are empty."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def _postings(nodes: DataFrame) -> DataFrame:
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    pairs = [(i, j) for i in range(4) for j in range(i)]
    keys = [
        F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j)) for n, (i, j) in enumerate(pairs)
    ]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("post"))


def shared_bytes(x: Column) -> Column:
    """Positional bytes in which two words agree whose exclusive or is x."""
    return sum((F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(0xFF)) == 0).cast("int") for i in range(8))


def links(nodes: DataFrame, posting: int = POSTING) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp`` whose closure is that of all pairs within ``DISTANCE`` bits."""
    posts = _postings(nodes)
    sizes = posts.groupBy("post").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = posts.join(sizes, "post")

    few = met.where(F.col("n") <= posting).groupBy("post").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    fps = F.col("fps")
    tallied = F.flatten(
        F.transform(
            fps,
            lambda a, i: F.filter(
                F.transform(
                    F.slice(fps, i + 2, F.size(fps)),
                    lambda b: F.struct(a.alias("a"), b.alias("b"), shared_bytes(a.bitwiseXOR(b)).alias("shared")),
                ),
                lambda p: p["shared"] >= SHARED_BYTES,
            ),
        )
    )
    pairs = few.select(F.explode(tallied).alias("p")).select("p.a", "p.b")
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)

    many = met.where(F.col("n") > posting).select("fp").distinct()
    near = many.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])).alias("word"))
    stars = near.groupBy("word").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps"))  # 65 members at most
    stars = stars.select("a", F.explode("fps").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of an edge (a, b): the smallest value that can be reached.

    Smallest neighbour, then the root's root, until nothing changes; each round is written to the checkpoint folder.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    state = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(state.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        step = state.join(near, "v").select("v", "root", F.least("root", "near").alias("hop"))
        far = state.select(F.col("v").alias("hop"), F.col("root").alias("far"))
        nxt = cut(step.join(far, "hop").select("v", F.least("hop", "far").alias("root"), (F.least("hop", "far") < F.col("root")).alias("moved")))
        state = nxt.select("v", "root")
        if not nxt.where("moved").limit(1).count():
            return state


def _linked_groups(docs: DataFrame) -> DataFrame:
    """k1, k2, fp, root for every distinct text by the links of ``near_duplicates``."""
    prints = cut(_text_prints(docs, WIDTH))
    roots = components(links(prints.select("fp").distinct())).withColumnRenamed("v", "fp")
    return prints.join(roots, "fp", "left").select("k1", "k2", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, posting: int = POSTING) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs`` (columns doc_id and text)."""
    prints = cut(fingerprints(docs))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes.select("fp"), posting)).withColumnRenamed("v", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(named, "root").select("fp", "component_id")
    return prints.join(placed, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _block_members(nodes: DataFrame, probes: bool) -> DataFrame:
    """Per 16-bit block and value the texts that have it; with ``probes`` also those that have it once a one is cleared."""
    keys = []
    for i in range(BITS // 16):
        block = F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)).cast("int")
        own = block.bitwiseOR(F.lit(i << 16))
        keys.append(F.struct(own.alias("key"), F.lit(True).alias("exact")))
        if probes:
            keys += [F.when(block.bitwiseAND(F.lit(1 << j)) != 0, F.struct(own.bitwiseXOR(F.lit(1 << j)).alias("key"), F.lit(False).alias("exact"))) for j in range(16)]
    posts = nodes.select("v", "fp", "root", F.explode(F.array(*keys)).alias("k")).where("k is not null")
    return posts.groupBy("k.key").agg(F.collect_list(F.struct("v", "fp", "root", F.col("k.exact").alias("exact"))).alias("m"))


def _led(key: int, v: np.ndarray, fp: np.ndarray, root: np.ndarray, exact: np.ndarray, distance: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each member with the leader of its run of neighbours; every block sorts the members another way.

    In a crowd there is a second leader for every sixteen runs: the member nearest to the majority of their bits. Copies
    that differ from one original in a word or two resemble it, not each other.
    """
    turn = np.uint64(16 * ((key >> 16) + 1) % BITS)
    order = np.argsort((fp << turn) | (fp >> (np.uint64(BITS) - turn)) if turn else fp, kind="stable")
    v, fp = v[order], fp[order]
    head = np.arange(len(v)) // size * size
    leaders = [head]
    if len(v) > size:
        middle = np.zeros(len(v), np.int64)
        for i in range(0, len(v), 16 * size):
            part = fp[i : i + 16 * size]
            ones = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            most = np.packbits(2 * ones > len(part), bitorder="little").view(np.uint64)[0]
            middle[i : i + 16 * size] = i + np.argmin(np.bitwise_count(part ^ most))
        leaders.append(middle)
    near = [(np.bitwise_count(fp ^ fp[h]) <= distance) & (v != v[h]) for h in leaders]
    return np.concatenate([v[h][n] for h, n in zip(leaders, near, strict=True)]), np.concatenate([v[n] for n in near])


def _met(key: int, v: np.ndarray, fp: np.ndarray, root: np.ndarray, exact: np.ndarray, distance: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an exact member and any member within the distance whose groups differ, in the first block where they meet."""
    if not exact.any() or (root == root[0]).all():
        return v[:0], v[:0]
    left, right = [], []
    order = np.flatnonzero(exact)[np.argsort(root[exact], kind="stable")]
    if len(order) * len(v) <= size:
        tiles = [(order, np.arange(len(v)))]
    else:  # a crowd: most members share a group, which is never held against itself
        tiles = [(own, np.flatnonzero(root != root[own[0]])) for own in np.split(order, np.flatnonzero(np.diff(root[order])) + 1)]
    for own, others in tiles:
        step = max(1, size // max(1, len(others)))
        for i in range(0, len(own), step):
            part = own[i : i + step]
            x, y = np.nonzero((np.bitwise_count(fp[part][:, None] ^ fp[others]) <= distance) & (root[part][:, None] != root[others]))
            x, y = part[x], others[y]
            first = ~exact[y] | (v[x] < v[y])  # two exact members meet in either order
            for block in range(key >> 16):
                first &= np.bitwise_count((fp[x] ^ fp[y]) >> np.uint64(16 * block) & np.uint64(0xFFFF)) > 1
            left.append(v[x[first]])
            right.append(v[y[first]])
    return np.concatenate(left), np.concatenate(right)


def _close(nodes: DataFrame, distance: int, probes: bool, size: int) -> DataFrame:
    """Pairs (a, b) of texts ``v`` whose fingerprints are close, without those of one group ``root``."""
    pair = _met if probes else _led

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, keys, members = b.column("m").offsets.to_numpy(), b.column("key").to_numpy(), b.column("m").values
            v, fp, root = (members.field(n).to_numpy() for n in ("v", "fp", "root"))
            exact = members.field("exact").to_numpy(zero_copy_only=False)
            for n, key in enumerate(keys):
                if ends[n + 1] - ends[n] > 1:
                    at = slice(ends[n], ends[n + 1])
                    x, y = pair(int(key), v[at], fp[at].view(np.uint64), root[at], exact[at], distance, size)
                    for i in range(0, len(x), TILE):
                        lo, hi = np.minimum(x[i : i + TILE], y[i : i + TILE]), np.maximum(x[i : i + TILE], y[i : i + TILE])
                        yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["a", "b"])

    return texts_in(_block_members(nodes, probes), "key", "m").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose texts have the similarity. Texts travel for the pairs' members only, once each and then per pair."""
    pairs = cut(pairs)
    members = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    wanted = nodes.join(members, "v", "left_semi").select("v", "k1", "k2")
    texts = docs.select(*text_key(F.col("text")), "text").join(wanted, ["k1", "k2"]).dropDuplicates(["v"])
    texts = cut(texts.select("v", F.coalesce("text", F.lit("")).alias("text")))
    both = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("v").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(64)(lambda t: np.unique(shingle_hashes(t, width)))
        for b in batches:
            good = [similarity_of(known(x.as_py()), known(y.as_py())) >= similarity for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return cut(texts_in(both, "a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _grouped(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(components(edges), "v", "left").withColumn("root", F.coalesce("root", "v"))


def _led_and_met(docs: DataFrame, nodes: DataFrame, width: int, distance: int, similarity: float, posting: int, tile: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of leaders within the rule, the groups that these join (``nodes`` with ``root``), and links between different groups."""
    led = _verified(_close(nodes.withColumn("root", F.col("v")), distance, probes=False, size=posting), nodes, docs, width, similarity)
    grouped = cut(_grouped(nodes, led))
    return led, grouped, _verified(_close(grouped, distance, probes=True, size=tile), nodes, docs, width, similarity)


def _text_prints(docs: DataFrame, width: int) -> DataFrame:
    """k1, k2, fp for every distinct text."""
    keyed = docs.select("text", *text_key(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([fingerprint(t.as_py(), width) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), prints], ["k1", "k2", "fp"])

    prints = texts_in(keyed, "k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, fp long")
    return prints.groupBy("k1", "k2").agg(F.first("fp").alias("fp"))


def similar_groups(docs: DataFrame, width: int, distance: int, similarity: float, posting: int = POSTING, tile: int = TILE) -> DataFrame:
    """k1, k2, fp, root for every distinct text: texts of one component have one root."""
    if not 0 <= distance <= FARTHEST:
        raise ValueError(f"distance must be 0 to {FARTHEST}")
    nodes = cut(_text_prints(docs, width).withColumn("v", F.monotonically_increasing_id()))
    _, grouped, met = _led_and_met(docs, nodes, width, distance, similarity, posting, tile)
    # the groups are joined as wholes: a crowd enters the rounds of ``components`` as one end, not as all its members
    at = lambda end, root: grouped.select(F.col("v").alias(end), F.col("root").alias(root))
    between = met.join(at("a", "ra"), "a").join(at("b", "rb"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    tops = components(between).select(F.col("v").alias("root"), F.col("root").alias("top"))
    return grouped.join(tops, "root", "left").select("k1", "k2", "fp", F.coalesce("top", "root").alias("root"))


def keep_first(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, similarity: float | None = None) -> DataFrame:
    """One row of every component with all its columns: the smallest id's, nulls last, then by fingerprint and text hash.

    Every row stands in the component of its own text, whatever other rows have its id. Without a similarity the
    links are those of ``near_duplicates``, whose width and distance are fixed.
    """
    if similarity is not None:
        groups = similar_groups(docs, width, distance, similarity)
    elif (width, distance) == (WIDTH, DISTANCE):
        groups = _linked_groups(docs)
    else:
        raise ValueError("another width or distance needs a similarity")
    keys = [k.alias(f"__{n}") for k, n in zip(text_key(F.col("text")), ("k1", "k2"), strict=True)]
    placed = docs.select("doc_id", *keys).join(groups.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "fp", "root"), ["__k1", "__k2"])
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), "fp", "__k1", "__k2")
    first = placed.groupBy("root").agg(F.min(rank).alias("__first")).select("__first.id", "__first.__k1", "__first.__k2")
    # "__" marks the stage's own columns: those of the table stay whatever their names
    chosen = first.select(F.col("id").alias("__id"), F.col("__k1").alias("__c1"), F.col("__k2").alias("__c2"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__k1") == F.col("__c1")) & (F.col("__k2") == F.col("__c2"))
    kept = docs.select("*", *keys).join(chosen, same, "left_semi")
    return kept.dropDuplicates(["doc_id", "__k1", "__k2"]).drop("__k1", "__k2")
