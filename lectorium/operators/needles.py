"""Many texts looked for at once: an automaton of all of them, one pass over what is searched.

A needle matches whole words; white space and typographic signs count as their plain forms. Needles are sent to the tasks
when they are short enough together (``MOST_CHARS``); more are dealt into rounds, each of which is sent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SIGNS, SPACES, normalize_match

#: Characters of needles that are sent at a time (an automaton has a state of some dozen bytes for each).
MOST_CHARS = 4_000_000
#: Characters of a lecture that are searched together.
STRETCH = 1 << 16

_TRANSLATED = str.maketrans(SIGNS)
_GAP = re.compile(f"[{SPACES}]+")


def plain_line(text: str) -> tuple[str, list[int] | None]:
    """The text in plain signs with single spaces, and the place of each of its characters; no list if none has moved."""
    text = text.translate(_TRANSLATED)
    gaps = [m.span() for m in _GAP.finditer(text)]
    if all(b - a == 1 for a, b in gaps):
        return _GAP.sub(" ", text), None
    places, at = [], 0
    for a, b in gaps:
        places.extend(range(at, a + 1))
        at = b
    places.extend(range(at, len(text)))
    return _GAP.sub(" ", text), places


class Finder:
    """All needles of a course."""

    def __init__(self, needles: list[tuple[int, str]]):
        import ahocorasick

        by_text: dict[str, list[int]] = {}
        for n, text in needles:
            by_text.setdefault(text, []).append(n)
        self.automaton = ahocorasick.Automaton()
        for text, numbers in by_text.items():
            self.automaton.add_word(text, (len(text), numbers))
        self.automaton.make_automaton()

    def hits(self, text: str, apart: bool = True) -> list[tuple[int, int, int]]:
        """(needle, start, end) of whole words, from left to right; if ``apart`` hits of one needle do not overlap."""
        line, places = plain_line(text)
        found, free = [], {}
        for last, (size, numbers) in self.automaton.iter(line):
            start, end = last + 1 - size, last + 1
            if (start and line[start - 1].isalnum()) or (end < len(line) and line[end].isalnum()):
                continue
            for n in numbers:
                if not apart or free.get(n, 0) <= start:
                    free[n] = end
                    found.append((n, start, end))
        if places is not None:
            found = [(n, places[a], places[b - 1] + 1) for n, a, b in found]
        return found


def _rounds(needles: DataFrame, key: str, most: int) -> Iterator[DataFrame]:
    total = needles.agg(F.coalesce(F.sum(F.length("find")), F.lit(0))).first()[0]
    n = max(1, -(-total // most))
    for i in range(n):
        yield needles.where(F.pmod(F.xxhash64(key, "find"), F.lit(n)) == i) if n > 1 else needles


def find_needles(texts: DataFrame, needles: DataFrame, scope: str, key: str, most: int = MOST_CHARS, apart: bool = True) -> DataFrame:
    """key, all columns of ``texts`` but its text, start, end: every place where a needle (scope, key, find) stands in a text of its scope."""
    rest = [c for c in texts.columns if c != "text"]
    usable = needles.select(scope, key, normalize_match(F.col("find")).alias("find")).where("find <> ''")
    schema = ", ".join(f"`{c}` {kind.schema[c].dataType.simpleString()}" for c, kind in [(key, needles), *((c, texts) for c in rest)]) + ", start int, end int"

    def one_round(mine: DataFrame) -> DataFrame:
        sent = texts.sparkSession.sparkContext.broadcast(mine.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = sent.value
            keys, by_scope, finders = table[key], {}, {}
            for i, (s, find) in enumerate(zip(table[scope].to_pylist(), table["find"].to_pylist(), strict=True)):
                by_scope.setdefault(s, []).append((i, find))
            for b in batches:
                rows, numbers, starts, ends = [], [], [], []
                for row, (s, text) in enumerate(zip(b.column(scope).to_pylist(), b.column("text").to_pylist(), strict=True)):
                    if text and s in by_scope and s is not None:
                        if s not in finders:
                            finders[s] = Finder(by_scope[s])
                        for n, start, end in finders[s].hits(text, apart):
                            rows.append(row)
                            numbers.append(n)
                            starts.append(start)
                            ends.append(end)
                own = b.select(rest).take(pa.array(rows, pa.int64()))
                found = keys.take(pa.array(numbers, pa.int64())).combine_chunks()
                found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
                yield pa.RecordBatch.from_arrays([found, *own.columns, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [key, *rest, "start", "end"])

        return texts.select(*rest, "text").mapInArrow(run, schema)

    return reduce(DataFrame.union, map(one_round, _rounds(usable, key, most)))


def locate_needles(segments: DataFrame, needles: DataFrame, stretch: int = STRETCH, most: int = MOST_CHARS) -> DataFrame:
    """needle_id, transcript_id, first_idx, first_at, last_idx, last_at: every place of a needle in the joined segments of a lecture.

    Segments (transcript_id, idx, text) are joined by single spaces, so a hit may begin in one and end in another; the last
    place is behind the hit. No lecture is put together: stretches of it overlap by the longest needle, and a hit belongs
    to the stretch in which it begins. A needle (needle_id, find) is looked for in every lecture.
    """
    plain = segments.select("transcript_id", "idx", normalize_match(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    before = Window.partitionBy("transcript_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = plain.withColumn("lo", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long"))
    longest = (needles.agg(F.coalesce(F.max(F.length("find")), F.lit(1))).first()[0] or 1) + 1
    # a stretch holds the characters from one before it, for the word's edge, to the longest needle behind it
    lo, hi = F.col("lo"), F.col("lo") + F.length("text")
    of = F.sequence(F.greatest(F.floor((lo - longest) / stretch), F.lit(0)), F.floor((hi + 1) / stretch))
    cut = placed.select("transcript_id", "idx", "lo", "text", F.explode(of).alias("stretch"))
    a = F.greatest(F.col("stretch") * stretch - 1, lo)
    b = F.least((F.col("stretch") + 1) * stretch + longest, hi)
    pieces = cut.select("transcript_id", "stretch", F.struct(a.alias("at"), "idx", (a - lo).alias("local"), F.substring("text", (a - lo + 1).cast("int"), (b - a).cast("int")).alias("t")).alias("p")).where(b > a)
    joined = pieces.groupBy("transcript_id", "stretch").agg(F.sort_array(F.collect_list("p")).alias("p"))  # bounded by the stretch
    texts = joined.select("transcript_id", "stretch", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"), F.col("p")[0]["at"].alias("from"), F.lit(0).alias("all"),
                          F.transform("p", lambda x: F.struct(x["at"].alias("at"), x["idx"].alias("idx"), x["local"].alias("local"))).alias("p"))
    hits = find_needles(texts, needles.select(F.lit(0).alias("all"), "needle_id", "find"), "all", "needle_id", most, apart=False)
    start, end = F.col("from") + F.col("start"), F.col("from") + F.col("end")
    hits = hits.where(F.floor(start / stretch) == F.col("stretch"))
    holder = lambda at: F.element_at(F.filter("p", lambda x: x["at"] <= at), -1)
    first, last = holder(start), holder(end - 1)
    return hits.select("needle_id", "transcript_id", first["idx"].alias("first_idx"), (first["local"] + start - first["at"]).alias("first_at"),
                       last["idx"].alias("last_idx"), (last["local"] + end - last["at"]).alias("last_at"))
