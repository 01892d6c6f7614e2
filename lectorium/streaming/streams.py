"""Structured Streaming: progress, chunks, deduplication and upkeep over files that arrive.

Every writer takes a folder. With the same folder a stopped stream goes on where it stood: files that were read are not
read again, state and written rows stay. Without one a new folder is made in the shared place, for a single run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import job_eta, job_progress, job_speed
from ..operators import upkeep
from ..operators.matching import match_pages
from ..operators.packing import pack
from ..operators.search import build_postings
from ..sources.folders import shared_base
from ..sources.snapshots import BucketTable, Snapshots

#: The state store that arbitrary state and timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_base(spark)}/{name}-{uuid.uuid4()}"


def arriving(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """A table's files as a stream, a few at a time; the table may be a folder or a single file.

    Streams take a plain path for a folder only; a pattern that stands for the same path may be either.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


@dataclass
class Run:
    """What one run of a stream has read and written."""

    folder: str
    batches: int = 0
    rows_read: int = 0
    rows_late: int = 0


def _ended(query: StreamingQuery, folder: str) -> Run:
    """Wait until all that is there has been read; counts every batch, also where Spark remembers the last ones only."""
    seen: dict[int, tuple[int, int]] = {}

    def look() -> None:
        for p in query.recentProgress:
            seen[p.batchId] = (p.numInputRows, sum(s.numRowsDroppedByWatermark for s in p.stateOperators))

    while not query.awaitTermination(1):
        look()
    look()
    return Run(folder, len(seen), sum(n for n, _ in seen.values()), sum(n for _, n in seen.values()))


def _writer(stream: DataFrame, folder: str, mode: str = "append"):
    return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)


def append(stream: DataFrame, folder: str) -> Run:
    """Append a stream to the rows of a folder until all that is there has been read."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKS)
    try:  # a query takes the setting when it starts
        query = _writer(stream, folder).format("parquet").option("path", f"{folder}/rows").start()
    finally:
        conf.set(name, before)
    return _ended(query, folder)


def to_table(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The rows of a folder after what is there has been appended."""
    folder = folder or shared_folder(stream.sparkSession, name)
    append(stream, folder)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def each_batch(stream: DataFrame, name: str, step: Callable[[DataFrame, int, str], None], mode: str = "append", folder: str | None = None) -> str:
    """Run ``step`` on every batch until all that is there has been read; gives the folder that it wrote to.

    A batch that fails runs again under its number, so a step must not count on being the first to see it.
    """
    folder = folder or shared_folder(stream.sparkSession, name)
    _ended(_writer(stream, folder, mode).foreachBatch(lambda df, n: step(df, n, folder)).start(), folder)
    return folder


def latest(stream: DataFrame, name: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """The last state of an aggregation by ``keys``.

    A batch writes only the groups that it changed, under its own number; what earlier batches wrote is never touched, so
    a batch that fails can run again. A reader takes each group's row of the last batch that has one.
    """

    def step(changed: DataFrame, n: int, folder: str) -> None:
        changed.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/changes/part={n}")

    folder = each_batch(stream, name, step, "update", folder)
    every = stream.sparkSession.read.parquet(f"{folder}/changes")
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "__batch").alias("__row"))
    return last.select("__row.*")


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_segments(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Segments without those that a resumed writer repeats: same job, time, kind and value.

    Rows that arrive more than ``delay`` of event time after the newest are late: they are left out and counted
    (``Run.rows_late``), and keys older than that leave the state.
    """
    return timed(events).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "ts", "event_type", "value"])


def stream_progress(events: DataFrame, total: float) -> DataFrame:
    """Per job: position in media seconds, segments so far, share of the total, media seconds per second, seconds left."""
    at = F.col("ts").cast("timestamp").cast("double")
    found = events.groupBy(F.col("user_id").alias("job_id")).agg(
        F.round(F.sum("value"), 4).alias("position"), F.count(F.lit(1)).alias("n_segments"), (F.max(at) - F.min(at)).alias("elapsed")
    )
    speed = job_speed(F.col("position"), F.lit(0.0), F.col("elapsed"))
    eta = F.round(job_eta(F.col("position"), F.lit(total), speed), 1)
    return found.select("job_id", "position", "n_segments", job_progress(F.col("position"), F.lit(total)).alias("progress"), F.round(speed, 6).alias("speed"), eta.alias("eta"))


def stream_windows(events: DataFrame, size: str = "1 day") -> DataFrame:
    """Per job and fixed window: first and number of segments and their seconds."""
    grouped = timed(events).groupBy(F.col("user_id").alias("job_id"), F.window("ts", size).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("seconds")).select("job_id", F.col("w.start").cast("timestamp_ntz").alias("chunk"), "n", "seconds")


def stream_job_board(events: DataFrame) -> DataFrame:
    """The last status of every job."""
    return events.groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("n"))


def flush_chunks(segments: DataFrame, every: float) -> DataFrame:
    """Chunks of a lecture's segments that close when at least ``every`` media seconds have passed since the last close."""
    packed = pack(segments.select("transcript_id", "idx", "end_s"), "transcript_id", "idx", None, every, total="end_s")
    return packed.select("transcript_id", F.col("idx").cast("long").alias("idx"), F.col("pack").alias("chunk"))


class Chunker(StatefulProcessor):
    """Numbers the chunks of a job's segments as they arrive, in any order and more than once.

    The state of a job is where it stands (next segment, media seconds, last close, chunk) and the segments that have
    come before their turn. It ends with the job's last segment, or when nothing has come for ``idle`` milliseconds of
    event time: then segments that wait are given out in order across the gap, so a missing one holds nothing for ever.
    Without event time nothing tells a late repeat from a new job, so of a finished job a mark stays.
    """

    def __init__(self, every: float, idle: int | None):
        self.every, self.idle = every, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, media double, closed double, chunk int")
        self.waiting = handle.getMapState("waiting", "idx long", "seconds double, last boolean")

    def _given(self, key, place: list, seconds: float) -> Row:
        n, media, closed, chunk = place
        media += seconds
        flush = media - closed >= self.every
        place[:] = [n + 1, media, media if flush else closed, chunk + flush]
        return Row(transcript_id=key[0], idx=n, chunk=chunk)

    def _end(self) -> None:
        if self.idle is None:
            self.place.update((-1, 0.0, 0.0, 0))
        else:
            self.place.clear()
        self.waiting.clear()
        self._wait(None)

    def _wait(self, until: int | None) -> None:
        """One timer at most; a stream without event time has none."""
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if until is not None:
                self.handle.registerTimer(until)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        place = list(self.place.get()) if self.place.exists() else [0, 0.0, 0.0, 0]
        if place[0] < 0:
            return
        come: dict[int, tuple[float, bool]] = {}
        newest = 0
        for r in rows:
            newest = max(newest, r.at_ms or 0)
            if r.idx >= place[0] and r.idx not in come:  # else it has been given out, or is repeated
                come[r.idx] = (r.seconds or 0.0, bool(r.last))
        while True:
            n = place[0]
            if n in come:
                seconds, last = come.pop(n)
                self.waiting.removeKey((n,))
            elif self.waiting.containsKey((n,)):
                seconds, last = self.waiting.getValue((n,))
                self.waiting.removeKey((n,))
            else:
                break
            yield self._given(key, place, seconds)
            if last:
                self._end()
                return
        for n, value in come.items():
            if not self.waiting.containsKey((n,)):
                self.waiting.updateValue((n,), value)
        self.place.update(tuple(place))
        self._wait(max(newest, timerValues.getCurrentWatermarkInMs() if self.idle is not None else 0) + (self.idle or 0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        place = list(self.place.get()) if self.place.exists() else [0, 0.0, 0.0, 0]
        for (n,), (seconds, _) in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
            place[0] = n
            yield self._given(key, place, seconds)
        self._end()

    def close(self) -> None:
        pass


def stream_flush_windows(segments: DataFrame, every: float, delay: str | None = None, idle_s: float = 3600.0) -> DataFrame:
    """transcript_id, idx, chunk of a stream of segments (transcript_id, idx from 0, seconds, last), as ``flush_chunks`` gives them.

    With a ``delay`` the stream has an event time ``ts``: rows later than that are left out, repeats of a segment within it
    too, and jobs that nothing has come for in ``idle_s`` seconds of event time end.
    """
    if delay is not None:
        segments = timed(segments).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["transcript_id", "idx"])
    segments = segments.withColumn("at_ms", F.lit(0) if delay is None else F.unix_millis("ts"))
    chunker = Chunker(every, None if delay is None else int(1000 * idle_s))
    schema = f"transcript_id {segments.schema['transcript_id'].dataType.simpleString()}, idx long, chunk int"
    return segments.groupBy("transcript_id").transformWithState(chunker, schema, "Append", "None" if delay is None else "EventTime")


class PostingsIndex:
    """Postings of documents that come, change and go: a log of segments that is merged as it grows.

    A batch is a segment: the ids that it speaks of, and their postings. An id is as its last segment says, so an empty
    or deleted document, which has no postings, takes away those of earlier segments. When ``fan`` segments of a level
    are there they are merged into one of the next, by ranges of tokens and sorted, without what later ones of them
    replaced; so there are fewer than ``fan`` segments for each digit of the number of batches.
    """

    IDS = "doc_id {0}, batch long"
    POSTINGS = "token string, doc_id {0}, pos int, batch long"

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "bigint", fan: int = 4):
        self.spark, self.fan, self.snapshots = spark, fan, Snapshots(spark, folder)
        self.ids, self.rows = self.IDS.format(id_type), self.POSTINGS.format(id_type)

    def _read(self, parts: list[str]) -> tuple[DataFrame, DataFrame]:
        read = lambda kind, schema: self.spark.read.schema(schema).parquet(*[f"{self.snapshots.folder}/{p}/{kind}" for p in parts])
        if not parts:
            return self.spark.createDataFrame([], self.ids), self.spark.createDataFrame([], self.rows)
        return read("ids", self.ids), read("postings", self.rows)

    def _live(self, parts: list[str]) -> tuple[DataFrame, DataFrame]:
        """Each id's last batch in some segments, and the postings of it."""
        ids, rows = self._read(parts)
        last = ids.groupBy("doc_id").agg(F.max("batch").alias("batch"))
        named = last.select(F.col("doc_id").alias("__doc"), F.col("batch").alias("__batch"))
        return last, rows.join(named, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("batch") == F.col("__batch")), "left_semi")

    def add(self, docs: DataFrame, n: int) -> None:
        """Batch ``n`` of documents (doc_id, text, perhaps deleted); rows of a batch that share an id are one document."""
        before = self.snapshots.last()
        if before.tags.get("batch", -1) >= n:
            return
        part = f"data/batch-{n}-{uuid.uuid4()}"
        docs.select("doc_id").distinct().withColumn("batch", F.lit(n).cast("long")).write.parquet(f"{self.snapshots.folder}/{part}/ids")
        there = docs.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in docs.columns else docs
        build_postings(there).select("token", "doc_id", "pos", F.lit(n).cast("long").alias("batch")).write.parquet(f"{self.snapshots.folder}/{part}/postings")
        self.snapshots.publish(before, before.parts | {f"0/{n:012}": part}, {"batch": n})
        self.merge()

    def merge(self) -> None:
        """Merge full levels, the lowest first; each merge is a manifest of its own."""
        while True:
            before = self.snapshots.last()
            levels: dict[int, list[str]] = {}
            for name in sorted(before.parts):
                levels.setdefault(int(name.partition("/")[0]), []).append(name)
            level = next((k for k in sorted(levels) if len(levels[k]) >= self.fan), None)
            if level is None:
                return
            full, part = levels[level], f"data/level-{level + 1}-{uuid.uuid4()}"
            last, live = self._live([before.parts[n] for n in full])
            live.repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id", "pos").write.parquet(f"{self.snapshots.folder}/{part}/postings")
            if level == max(levels):  # nothing older is left that an id without postings could take away
                last = last.join(live.select(F.col("doc_id").alias("__doc")).distinct(), F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi")
            last.write.parquet(f"{self.snapshots.folder}/{part}/ids")
            name = f"{level + 1}/{full[0].partition('/')[2]}"
            self.snapshots.publish(before, {k: v for k, v in before.parts.items() if k not in full} | {name: part}, {})

    def postings(self) -> DataFrame:
        """token, doc_id, pos of the documents as they are now."""
        return self._live(list(self.snapshots.last().parts.values()))[1].select("doc_id", "pos", "token")


def stream_index_upkeep(docs: DataFrame, name: str = "postings", folder: str | None = None, fan: int = 4) -> DataFrame:
    """Postings kept equal to a stream of documents (doc_id, text, perhaps deleted): each batch replaces what the index had of its ids."""
    folder = folder or shared_folder(docs.sparkSession, name)
    index = PostingsIndex(docs.sparkSession, f"{folder}/index", docs.schema["doc_id"].dataType.simpleString(), fan)
    each_batch(docs, name, lambda batch, n, _: index.add(batch, n), folder=folder)
    return index.postings()


class MatchedCourses:
    """Vectors of pages and lectures, and the links that follow from them, in buckets of courses."""

    PAGES = "project_id long, deck long, page_no long, vec array<double>, source_sha string"
    LECTURES = "project_id long, transcript_id long, vec array<double>, source_sha string"
    LINKS = "project_id long, deck long, page_from long, page_to long, transcript_id long, score double, link_source string"
    CHANGES = "kind string, project_id long, deck long, page_no long, transcript_id long, vec array<double>, source_sha string"

    def __init__(self, spark: SparkSession, folder: str, threshold: float = 0.60, margin: float = 0.02, buckets: int = 64):
        self.spark, self.folder, self.threshold, self.margin = spark, folder, threshold, margin
        table = lambda name, schema: BucketTable(spark, f"{folder}/{name}", schema, ["project_id"], buckets)
        self.pages, self.lectures, self.links = table("pages", self.PAGES), table("lectures", self.LECTURES), table("links", self.LINKS)
        self.steps = Snapshots(spark, f"{folder}/steps")

    def _changed(self, table: BucketTable, rows: DataFrame, key: list[str]) -> DataFrame:
        """Rows whose content is not the stored one."""
        stored = table.read(table.touched(rows)).select(*key, "source_sha")
        return rows.join(stored, [*key, "source_sha"], "left_anti")

    def apply(self, pages: DataFrame | None, lectures: DataFrame | None, n: int, name: str = "vectors") -> None:
        """Batch ``n`` of vectors: those of changed content are stored, and their courses are matched anew.

        A null vector takes the page or lecture away. Which courses are touched is written down first, so that a batch
        that failed half way ends with the same links when it runs again.
        """
        given = [(t, rows, key) for t, rows, key in ((self.pages, pages, ["project_id", "deck", "page_no"]), (self.lectures, lectures, ["project_id", "transcript_id"])) if rows is not None]
        noted = f"{name}-{n}"
        if not self.steps.exists(f"{noted}/_SUCCESS"):
            found = [self._changed(t, rows, key).select("project_id") for t, rows, key in given]
            courses = found[0] if len(found) == 1 else found[0].union(found[1])
            courses.distinct().write.mode("overwrite").parquet(f"{self.steps.folder}/{noted}")
        courses = self.spark.read.schema("project_id long").parquet(f"{self.steps.folder}/{noted}")
        for table, rows, key in given:
            mine = rows.join(courses, "project_id", "left_semi")
            table.change(mine, lambda current, mine=mine, key=key: self._stored(current, mine, key), (name, n))
        self.links.change(courses, lambda current: self._matched(current, courses), (name, n))

    def keep(self, batch: DataFrame, n: int, name: str = "vectors") -> None:
        """Write down batch ``n`` of a stream for ``catch_up``; one that comes again takes the place of its first try."""
        batch.write.mode("overwrite").parquet(f"{self.steps.folder}/kept-{name}/__batch={n}")

    def catch_up(self, schema: StructType, name: str = "vectors", content: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Apply all kept batches that have not been applied, as one: of a page or lecture that came in several the last counts.

        So a course is matched once, however many batches touch it. What is applied is written down first under its last
        number: a try that failed half way is ended with the same rows before later batches are looked at.
        """
        kept, taken = f"kept-{name}", f"taken-{name}"
        whole = lambda top, start: {int(n.removeprefix(start)) for n in self.steps.names(top) if self.steps.exists(f"{top}/{n}/_SUCCESS")}
        done, come = self.links.snapshots.last().tags.get(name, -1), whole(kept, "__batch=")
        ends = whole(taken, "") | ({max(come)} if come else set())
        for end in sorted(n for n in ends if n > done):
            at = f"{self.steps.folder}/{taken}/{end}"
            if not self.steps.exists(f"{taken}/{end}/_SUCCESS"):
                reader = self.spark.read.schema(StructType([*schema, StructField("__batch", LongType())])).option("basePath", f"{self.steps.folder}/{kept}")
                rows = reader.parquet(*[f"{self.steps.folder}/{kept}/__batch={n}" for n in sorted(come) if done < n <= end])
                self._newest(rows if content is None else content(rows)).write.mode("overwrite").parquet(at)
            rows = self.spark.read.schema(self.CHANGES).parquet(at)
            pages = rows.where("kind = 'page'").select("project_id", "deck", "page_no", "vec", "source_sha")
            lectures = rows.where("kind = 'lecture'").select("project_id", "transcript_id", "vec", "source_sha")
            self.apply(pages, lectures, end, name)
            done = end
        for n in sorted(come):
            if n <= done:
                self.steps.drop(f"{kept}/__batch={n}")
        self.steps.drop(taken)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The last row of each page and lecture."""
        only = lambda kind, c: F.when(F.col("kind") == kind, F.col(c)).cast("long").alias(c)
        key = ["kind", F.col("project_id").cast("long").alias("project_id"), only("page", "deck"), only("page", "page_no"), only("lecture", "transcript_id")]
        last = rows.groupBy(*key).agg(F.max_by(F.struct("vec", "source_sha"), "__batch").alias("__row"))
        return last.select("kind", "project_id", "deck", "page_no", "transcript_id", F.col("__row.vec").cast("array<double>").alias("vec"), "__row.source_sha")

    def _stored(self, current: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
        kept = current.join(rows.select(*key), key, "left_anti")
        return kept.unionByName(rows.where("vec is not null").select(*current.columns).dropDuplicates(key))

    def _matched(self, current: DataFrame, courses: DataFrame) -> DataFrame:
        touched = self.links.touched(courses)
        own = lambda table: table.read(touched).join(courses, "project_id", "left_semi")
        pages = own(self.pages)
        fresh = match_pages(pages, own(self.lectures), self.threshold, self.margin)
        decks = pages.select("project_id", "deck").distinct()
        gone = current.select("project_id", "deck").distinct().join(courses, "project_id", "left_semi")
        fresh = fresh.join(decks, "deck").withColumn("link_source", F.lit("auto"))
        return upkeep.refresh_auto_links(current, fresh.select(*current.columns), decks.union(gone).distinct())


def stream_restale(
    changes: DataFrame, store: Callable[[str], MatchedCourses], name: str = "vectors", folder: str | None = None, content: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Links of all courses after a stream of vectors (kind page or lecture, the keys, vec, source_sha): only courses of changed content are matched.

    A batch is only written down; when all that is there has been read, the courses that its batches touch are matched, once
    each, so the work does not grow with batches times stored pages. ``store`` makes the stored courses of the stream's folder.
    With ``content`` the stream may name its changes only, in columns of its own: it turns all that have come since the last
    matching into the columns above, once, and keeps ``__batch``.
    """
    folder = folder or shared_folder(changes.sparkSession, name)
    courses = store(folder)
    each_batch(changes, name, lambda batch, n, _: courses.keep(batch, n, name), folder=folder)
    courses.catch_up(changes.schema, name, content)
    return courses.links.read()
