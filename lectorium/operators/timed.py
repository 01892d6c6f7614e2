"""Timed text: parsing, offsets, re-timing, markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fmt_ts
from ..sources.folders import materialised
from .edits import apply_glossary

STAMP = r"^\s*\[(?:(\d+):)?(\d{1,2}):(\d{2})\]\s*(.*)$"


def stamp_seconds(line: Column) -> Column:
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(line, STAMP, i), F.lit("")), F.lit("0")).cast("double")
    return F.when(line.rlike(STAMP), part(1) * 3600 + part(2) * 60 + part(3))


def scan_timed_text(files: DataFrame) -> DataFrame:
    """Segments of files (path, value): a line without a time belongs to the segment before it; lines before the
    first time are put in front of it; a file without any time is one segment from 0."""
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")).where(F.trim("line") != "")
    w = Window.partitionBy("path").orderBy("pos")
    timed = lines.withColumn("at", stamp_seconds(F.col("line"))).withColumn("island", F.sum(F.col("at").isNotNull().cast("int")).over(w))
    body = F.when(F.col("at").isNotNull(), F.trim(F.regexp_extract("line", STAMP, 4))).otherwise(F.trim("line"))
    any_time = F.max("island").over(Window.partitionBy("path"))
    timed = timed.withColumn("body", body).withColumn("lead", (F.col("island") == 0) & (any_time > 0)).withColumn("island", F.greatest("island", F.least(any_time, F.lit(1))))
    joined = lambda lead, glue: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("lead") == lead, F.struct("pos", "body")))), lambda x: x["body"]), glue)
    rows = timed.groupBy("path", "island").agg(F.max("at").alias("start"), joined(True, " ").alias("front"), joined(False, "\n").alias("rest"))
    rows = rows.select("path", "island", F.coalesce("start", F.lit(0.0)).alias("start"), F.col("start").isNotNull().alias("ts"), F.trim(F.concat_ws(" ", F.nullif("front", F.lit("")), "rest")).alias("text"))
    order = Window.partitionBy("path").orderBy("island")
    out = rows.select("path", (F.row_number().over(order) - 1).alias("idx"), "start", F.coalesce(F.lead("start").over(order), "start").alias("end"), "text", "ts")
    return segment_offsets(out, "path", "idx")


def segment_offsets(segments: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("long"))


def time_buckets(segments: DataFrame, seconds: int = 300) -> DataFrame:
    """The bucket of each segment, and whether it is the first of its bucket."""
    w = Window.partitionBy("transcript_id").orderBy("idx")
    bucket = F.floor(F.col("start_s") / seconds).cast("long")
    return segments.withColumn("bucket", bucket).withColumn("heading", ~F.lag("bucket").over(w).eqNullSafe(F.col("bucket")))


def segments_to_markdown(segments: DataFrame, seconds: int = 300) -> DataFrame:
    """One markdown text per lecture with a heading where the bucket changes."""
    line = F.concat(F.when(F.col("heading"), F.concat(F.lit("## "), fmt_ts(F.col("bucket") * float(seconds)), F.lit("\n"))).otherwise(""), F.col("text"))
    marked = time_buckets(segments, seconds).select("transcript_id", "idx", line.alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n")
    return marked.groupBy("transcript_id").agg(F.concat(F.lit("# Lecture "), F.first("transcript_id").cast("string"), F.lit("\n"), body).alias("markdown"))


def retime_segments(lines: DataFrame, previous: DataFrame) -> DataFrame:
    """Times for edited lines (transcript_id, idx, text, at) from explicit times, old starts and interpolation.

    An explicit time wins over the old start of the same place. Times that are known are made to rise; lines
    between two known ones are spread evenly up to the next known time as it stands, after the last up to the
    duration, before the first at 0; with none known they are spread over the duration, or one a second.
    """
    old = previous.select("transcript_id", "idx", F.col("start_s").alias("__old"))
    duration = previous.groupBy("transcript_id").agg(F.max(F.coalesce("end_s", "start_s")).alias("__duration"))
    rows = lines.join(old, ["transcript_id", "idx"], "left").join(duration, "transcript_id", "left")
    rows = rows.select("transcript_id", "idx", "text", F.col("at").isNotNull().alias("ts"), F.coalesce("at", "__old").alias("raw"), F.coalesce("__duration", F.lit(0.0)).alias("duration"))
    w = Window.partitionBy("transcript_id").orderBy("idx")
    back, forth = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy("transcript_id")
    known = F.col("raw").isNotNull()
    rows = rows.select(
        "*",
        F.when(F.max("raw").over(back).isNotNull(), F.greatest(F.max("raw").over(back), F.lit(0.0))).alias("from_s"),
        F.last(F.when(known, F.col("idx")), True).over(back).alias("from_i"),
        F.first("raw", True).over(forth).alias("to_s"),
        F.first(F.when(known, F.col("idx")), True).over(forth).alias("to_i"),
        F.count(F.lit(1)).over(all_rows).alias("n"),
        F.min("idx").over(all_rows).alias("i0"),
        F.count("raw").over(all_rows).alias("n_known"),
    )
    place = F.col("idx") - F.col("i0")
    to_s, to_i = F.coalesce("to_s", "duration"), F.coalesce("to_i", F.col("i0") + F.col("n"))
    between = F.col("from_s") + (to_s - F.col("from_s")) / (to_i - F.col("from_i")) * (F.col("idx") - F.col("from_i"))
    spread = F.when(F.col("duration") > 0, F.col("duration") * place / F.col("n")).otherwise(place.cast("double"))
    start = F.when(F.col("n_known") == 0, spread).when(known, F.col("from_s")).when(F.col("from_i").isNull(), 0.0).otherwise(between)
    timed = rows.withColumn("start_s", start).withColumn("start_s", F.max("start_s").over(back))
    end = F.coalesce(F.lead("start_s").over(w), F.greatest("duration", "start_s"))
    return segment_offsets(timed.withColumn("end_s", end), "transcript_id", "idx").select("transcript_id", "idx", "start_s", "end_s", "text", "ts", "offset")


def import_transcripts(files: DataFrame, terms: DataFrame, previous: DataFrame) -> DataFrame:
    """Segments of files (path, value, project_id, transcript_id) as they are stored: parsed, corrected by the course's
    automatic terms, timed over what was stored before (transcript_id, idx, start_s, end_s).

    ``revised`` says where a term has changed the text; ``n_applied`` counts the terms that matched.
    """
    parsed = scan_timed_text(files.select("path", "value")).join(files.select("path", "project_id", "transcript_id"), "path")
    raw = parsed.select("project_id", "transcript_id", "idx", "text", F.when(F.col("ts"), F.col("start")).alias("at"))
    fixed = apply_glossary(raw.select("project_id", "transcript_id", "idx", "text"), terms).select("transcript_id", "idx", F.col("text").alias("new"), "n_applied")
    lines = materialised(raw.join(fixed, ["transcript_id", "idx"]))
    stored = retime_segments(lines.select("transcript_id", "idx", F.col("new").alias("text"), "at"), previous)
    marks = lines.select("project_id", "transcript_id", "idx", (F.col("new") != F.col("text")).alias("revised"), "n_applied")
    return stored.join(marks, ["transcript_id", "idx"])


def revisions(imported: DataFrame) -> DataFrame:
    """transcript_id, n_applied: a row for each transcript in which a term has matched."""
    return imported.groupBy("project_id", "transcript_id").agg(F.sum("n_applied").alias("n_applied")).where("n_applied > 0")


def resume_filter(segments: DataFrame, offset: float) -> DataFrame:
    return segments.where(F.col("end_s") > offset)


def resume_point(lines: DataFrame, margin: float = 2.0) -> DataFrame:
    """Seconds from which to go on after the last timed line of a partial file (path, pos, line); 0 without one."""
    last = lines.withColumn("at", stamp_seconds(F.col("line"))).groupBy("path").agg(F.max_by("at", F.when(F.col("at").isNotNull(), F.col("pos"))).alias("at"))
    return last.select("path", F.greatest(F.coalesce(F.col("at") - margin, F.lit(0.0)), F.lit(0.0)).alias("resume_s"))


def scan_paged_text(docs: DataFrame, chars: int = 3000, gap: str = "\n\n") -> DataFrame:
    """Pages of about ``chars`` characters; a block is never split, and a page closes when the next would not fit."""
    page = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"))

    def step(a: Column, block: Column) -> Column:
        full = (a["text"] != "") & (F.length(a["text"]) + F.length(block) > chars)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["text"]))).otherwise(a["done"]).alias("done"),
            F.when(full | (a["text"] == ""), block).otherwise(F.concat(a["text"], F.lit(gap), block)).alias("text"),
        )

    blocks = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), gap), lambda b: F.trim(b)), lambda b: b != "")
    pages = F.aggregate(blocks, page, step, lambda a: F.when(a["text"] != "", F.concat(a["done"], F.array(a["text"]))).otherwise(a["done"]))
    return docs.select("doc_id", F.posexplode(pages).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("page_no"), "text")
