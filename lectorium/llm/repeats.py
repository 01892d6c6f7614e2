"""Where do windows of ``length`` units (bytes or words) occur twice or more in a corpus?

The frame of the two substring operators. No window is listed for all texts; instead

1. every window of ``length`` units names an anchor, the ``gram`` consecutive units in it whose hash is smallest.
   Equal windows name equal anchors, and a text has about ``2 / (length - gram)`` anchors per unit;
2. anchors whose hash occurs once are dropped (a count with partial aggregation, then a join: a hot anchor is
   split like any skewed join);
3. an anchor's context is all windows around it. Contexts that are equal whole, by 128 hashed bits, are repeated whole
   (a class of two or more members), with no look at the text; of every class one member goes on;
4. classes that share an anchor but differ meet in the operator's ``engine``, which compares their text exactly. An
   anchor with more than ``group_rows`` classes is split: the places that it can take in a window are halved, and
   either half deals the contexts out by the units that all its windows share, a longer gram. Contexts that share it
   with no other are done; groups that fit go to the engine, the others are halved again. In the end a half is one
   place, the gram a whole window, and the group is repeated as it stands.

With ``longest`` a second, longer window is looked for as well; a range found says which of the two it holds.

Texts are keyed by 128 hashed bits; rows get their results by key, so repeated rows, repeated ids and null ids need no
special treatment. Null and empty texts, and texts shorter than a window, hold no window. Very long texts are hashed
in chunks of ``CHUNK`` units. Ties between equal grams of a window go to the first. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, text_key, texts_in

#: Units of a text hashed at a time, and bits for a place within them.
CHUNK, PLACE_BITS = 1 << 20, 24
#: Keys of texts (16 bytes each) up to which they are sent to all executors.
FEW_TEXTS = 500_000
#: Two odd bases: ranges are equal if both hashes are.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Window:
    unit: str  # "byte" or "word"
    length: int
    gram: int
    group_rows: int  # contexts of one anchor that meet in the engine; more are split by longer grams
    longest: int | None = None  # a second length, at least the first

    @property
    def lengths(self) -> tuple[int, ...]:
        return (self.length,) if self.longest is None else (self.length, self.longest)

    @property
    def reach(self) -> int:
        """Units from an anchor's start that its windows can reach."""
        return max(self.lengths)

    @property
    def left(self) -> int:
        """Units before an anchor that its windows can reach."""
        return self.reach - self.gram


class _Powers:
    """Powers of a hash base and of its inverse, modulo 2**64, grown when needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(2 * n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


_powers = [_Powers(b) for b in BASES]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class RangeHash:
    """Hashes of any ranges of a sequence of 64-bit codes, from prefix sums."""

    def __init__(self, codes: np.ndarray, base: int = 0):
        up, self.down = _powers[base].of(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:-1], out=self.sums[1:])

    def of(self, start, end):
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def sliding(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def find_anchors(codes: np.ndarray, w: Window) -> list[np.ndarray]:
    """Places, gram hashes and two context hashes of all anchors of a text."""
    found: list[list[np.ndarray]] = []
    n, low, choice = len(codes), np.uint64((1 << PLACE_BITS) - 1), w.length - w.gram
    for begin in range(0, max(n - w.length + 1, 0), CHUNK):  # windows that begin in this chunk
        a, z = max(0, begin - w.left), min(n, begin + CHUNK + 2 * w.reach)
        hashes = RangeHash(codes[a:z])
        grams = _mixed(hashes.sliding(w.gram))
        first, last = begin - a, min(begin + CHUNK, n - w.length + 1) - 1 - a
        keys = (grams[first : last + choice + 1] & ~low) | np.arange(first, last + choice + 1, dtype=np.uint64)
        at = (sliding_min(keys, choice + 1) & low).astype(np.int64)
        at = at[np.flatnonzero(np.diff(at, prepend=-1))]
        start, end = np.maximum(at - w.left, 0), np.minimum(at + w.reach, z - a)
        cropped = (at - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + (end - at).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        whole = [_mixed(h.of(start, end) + cropped).view(np.int64) for h in (hashes, RangeHash(codes[a:z], 1))]
        found.append([at + a, grams[at].view(np.int64), *whole])
    if len(found) == 1:
        return found[0]
    if not found:
        return [np.zeros(0, np.int64)] * 4
    at, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
    at, first = np.unique(at, return_index=True)
    return [at, *(x[first] for x in rest)]


class _WordCodes(dict):
    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word, 7)
        if len(self) < 1_000_000:
            self[word] = code
        return code


def coder(w: Window) -> Callable[[str], np.ndarray]:
    """A function from a text to the 64-bit codes of its units; fewer than a window's length come back as none."""
    if w.unit == "byte":
        values = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)
        return lambda text: values[np.frombuffer(text.encode(), np.uint8)]
    codes = _WordCodes()

    def of_words(text: str) -> np.ndarray:
        words = text.encode().split()  # bytes: exactly the six ASCII spaces separate
        return np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))

    return of_words


def keyed_texts(docs: DataFrame, w: Window) -> DataFrame:
    """k1, k2, text of every row that is long enough for one window."""
    least = w.length if w.unit == "byte" else 2 * w.length - 1
    return texts_in(docs.where(F.octet_length("text") >= least), *text_key(F.col("text")), "text")


def distinct_texts(docs: DataFrame, w: Window) -> DataFrame:
    return keyed_texts(docs, w).groupBy("k1", "k2").agg(F.first("text").alias("text"))


def anchors(texts: DataFrame, w: Window) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(w)
        for b in batches:
            parts = [find_anchors(code(t.as_py()), w) for t in b.column("text")]
            counts = np.array([len(p[0]) for p in parts], np.int64)
            at, gram, c1, c2 = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4))
            keys = [pa.array(np.repeat(b.column(c).to_numpy(), counts)) for c in ("k1", "k2")]
            cells = [pa.array(gram), pa.array(c1), pa.array(c2), *keys, pa.array(at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cells, ["gram", "c1", "c2", "k1", "k2", "at"])

    return texts.mapInArrow(run, "gram long, c1 long, c2 long, k1 long, k2 long, at int")


CONTEXT = {"gram": pa.int64(), "lone": pa.bool_(), "k1": pa.int64(), "k2": pa.int64(), "at": pa.int32(), "left": pa.int32(), "units": pa.binary()}
SPAN = {"k1": pa.int64(), "k2": pa.int64(), "start": pa.int32(), "end": pa.int32(), "length": pa.int32()}
CONTEXT_SCHEMA = "gram long, lone boolean, k1 long, k2 long, at int, left int, units binary"
SPAN_SCHEMA = "k1 long, k2 long, start int, end int, length int"


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


def _contexts(texts: DataFrame, members: DataFrame, w: Window) -> DataFrame:
    """The text around members (gram, lone, k1, k2, at): adds ``left``, the units before the anchor, and ``units``."""
    by_text = members.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "lone", "at")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k1, k2, text, own in zip(*[b.column(c).to_pylist() for c in ("k1", "k2", "text", "members")], strict=True):
                units = text.encode() if w.unit == "byte" else text.encode().split()
                for m in own:
                    start = max(0, m["at"] - w.left)
                    piece = units[start : m["at"] + w.reach]
                    rows.append((m["gram"], m["lone"], k1, k2, m["at"], m["at"] - start, piece if w.unit == "byte" else b" ".join(piece)))
                    if len(rows) >= 4096:
                        yield _batch(rows, CONTEXT)
                        rows = []
            yield _batch(rows, CONTEXT)

    return texts.join(by_text, ["k1", "k2"]).select("k1", "k2", "text", "members").mapInArrow(run, CONTEXT_SCHEMA)


#: An engine gets whole groups, as lists sorted by gram of rows (gram, lone, k1, k2, at, left, units), and gives
#: (k1, k2, start, end, length) of what is repeated in those that are alone in their class.
Engine = Callable[[list[tuple], Window], list[tuple[int, int, int, int, int]]]


def _run_engine(contexts: DataFrame, w: Window, engine: Engine, batch_rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            held += zip(*[b.column(c).to_pylist() for c in CONTEXT], strict=True)
            while len(held) > batch_rows and held[0][0] != held[-1][0]:
                stop = min(batch_rows, len(held) - 1)
                while stop < len(held) and held[stop][0] == held[stop - 1][0]:
                    stop += 1
                if stop == len(held):  # the last group may go on
                    stop = next(i for i in range(len(held) - 1, 0, -1) if held[i][0] != held[i - 1][0])
                yield _batch(engine(held[:stop], w), SPAN)
                held = held[stop:]
        yield _batch(engine(held, w) if held else [], SPAN)

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, SPAN_SCHEMA)


def _halves(rows: DataFrame, w: Window) -> DataFrame:
    """Rows (length, low, high, and a context) by either half of the places ``low`` to ``high`` before an anchor at
    which a window of ``length`` may begin: the hashes g1, g2 of the units that all windows of the half share, and
    c1, c2 of those that any of them covers, to which the context is cropped."""
    values = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(w)
        for b in batches:
            units = [u.as_py() for u in b.column("units")]
            codes = [words(u.decode()) if w.unit == "word" else values[np.frombuffer(u, np.uint8)] for u in units]
            size = np.array([len(c) for c in codes], np.int64)
            base = np.cumsum(size) - size
            hashes = [RangeHash(np.concatenate(codes) if codes else np.zeros(0, np.uint64), i) for i in (0, 1)]
            length, low, high, left, gram = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "low", "high", "left", "gram"))
            middle = (low + high) // 2
            for near, far in ((low, middle), (middle + 1, high)):
                i = np.flatnonzero((low < high) & (left >= near) & (left - far + length <= size))
                near, far = near[i], far[i]
                place = sum(x.view(np.uint64) * np.uint64(m) for x, m in ((near, 3), (far, 5), (length[i], 7), (gram[i], 11)))
                cells = []
                for before, after in ((near, length[i] - far), (np.minimum(far, left[i]), np.minimum(length[i] - near, size[i] - left[i]))):
                    at, cropped = base[i] + left[i], place + before.view(np.uint64) * np.uint64(13) + after.view(np.uint64) * np.uint64(17)
                    cells += [pa.array(_mixed(h.of(at - before, at + after) + cropped).view(np.int64)) for h in hashes]
                cells += [pa.array(x.astype(np.int32)) for x in (length[i], near, far)]
                pieces = [crop(units[r], s, e) for r, s, e in zip(i, (left[i] - before).tolist(), (left[i] + after).tolist(), strict=True)]
                own = b.select(["gram", "lone", "k1", "k2", "at"]).take(pa.array(i)).columns
                cells += [*own, pa.array(before.astype(np.int32)), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, ["g1", "g2", "c1", "c2", "length", "low", "high", *CONTEXT])

    def crop(units: bytes, start: int, end: int) -> bytes:
        return units[start:end] if w.unit == "byte" else b" ".join(units.split()[start:end])

    return rows.mapInArrow(run, "g1 long, g2 long, c1 long, c2 long, length int, low int, high int, " + CONTEXT_SCHEMA)


def _split(contexts: DataFrame, w: Window) -> tuple[list[DataFrame], list[DataFrame]]:
    """Crowded anchors' contexts in groups for the engine, and ranges that need none. Each round is written.

    What the windows of a half cover is a context of its own: where it is equal in two or more members, these are
    settled and one stands for all. So a member goes on only in the halves that a repeated passage fills in part.
    """
    fit, settled, left = [], [], None
    for length in w.lengths:
        whole = contexts.select(F.lit(length).alias("length"), F.lit(0).alias("low"), F.lit(length - w.gram).alias("high"), "*")
        left = whole if left is None else left.union(whole)
    half, own = ["g1", "g2"], ["c1", "c2"]
    while True:
        halves = cut(_halves(left, w))
        classes = cut(halves.groupBy(*half, *own).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at")).alias("m")))
        sizes = cut(classes.groupBy(*half).agg(F.count(F.lit(1)).alias("size")))
        sized = cut(classes.join(sizes, half).where("n > 1 or size > 1"))  # thin rows: the contexts move once, below
        met = halves.join(sized, [*half, *own])
        equal = met.where("n > 1 and lone")
        settled.append(equal.select("k1", "k2", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + F.col("length")).alias("end"), "length"))
        first = met.where(F.struct("k1", "k2", "at") == F.col("m")).withColumn("lone", F.col("lone") & (F.col("n") == 1))
        fits = F.col("size") <= max(1, w.group_rows)
        fit.append(first.where((F.col("size") > 1) & fits).select(F.col("g1").alias("gram"), *[c for c in CONTEXT if c != "gram"]))
        if not sized.where(~fits).limit(1).count():
            return fit, settled
        left = first.where(~fits).select("length", "low", "high", *CONTEXT)


def repeated_spans(docs: DataFrame, texts: DataFrame, w: Window, engine: Engine, batch_rows: int) -> DataFrame:
    """k1, k2, spans: ranges (start, end, length) that together hold every repeated window of a length (they may
    overlap or pass the text's ends; length is null where a range holds for every length that it spans).

    Anchors are found where the rows lie, copies included, before any text moves; those that occur twice are written
    once, since several joins below start from them. So are the counts that they are joined with: a join can split a hot
    key only if no aggregation by that key stands right below it. ``texts`` (distinct) is shuffled once for the contexts
    and the caller; those with crowded anchors once more, picked out before they move where their keys are few.
    """
    found = anchors(keyed_texts(docs, w), w)
    common = cut(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    met = cut(found.join(common, "gram"))
    classes = cut(met.groupBy("gram", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at")).alias("m")))
    whole = met.join(classes.where("n > 1").select("gram", "c1", "c2"), ["gram", "c1", "c2"])
    whole = whole.select("k1", "k2", (F.col("at") - w.left).alias("start"), (F.col("at") + w.reach).alias("end"), F.lit(None).cast("int").alias("length"))
    sizes = cut(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    mixed = classes.join(sizes, "gram").select("gram", (F.col("n") == 1).alias("lone"), "m.*", "size")
    groups, every = _contexts(texts, mixed.where(F.col("size") <= w.group_rows), w), whole
    if sizes.where(F.col("size") > w.group_rows).limit(1).count():
        crowded = cut(mixed.where(F.col("size") > w.group_rows))
        keys = crowded.select("k1", "k2").distinct()
        near = keyed_texts(docs, w).join(broadcast_if_small(keys, keys.count(), FEW_TEXTS), ["k1", "k2"], "left_semi")
        fit, settled = _split(_contexts(near.dropDuplicates(["k1", "k2"]), crowded, w), w)
        for part in fit:
            groups = groups.union(part)
        for part in settled:
            every = every.union(part)
    every = every.union(_run_engine(groups, w, engine, batch_rows))
    return every.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end", "length")).alias("spans"))


def merged(spans: list, n: int, length: int) -> list[tuple[int, int]]:
    """Maximal disjoint ranges of windows of ``length`` within a text of n units; what is too short holds none."""
    out: list[tuple[int, int]] = []
    own = [s for s in spans if s["length"] is None or s["length"] >= length]
    for s, e in sorted((max(0, s["start"]), min(n, s["end"])) for s in own):
        if e - s < length:
            continue
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out
