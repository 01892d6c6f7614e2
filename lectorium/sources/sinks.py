"""Exports: tables of (path, content) and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_slug, fmt_ts
from ..operators.timed import segments_to_markdown


def ordered(column: str, glue: str):
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", column))), lambda x: x[column]), glue)


def transcript_exports(segments: DataFrame) -> DataFrame:
    """transcript_id, format, content: plain text, text with times, JSON, and markdown with a heading every five minutes."""
    line = F.concat(F.lit("["), fmt_ts(F.col("start_s")), F.lit("] "), "text")
    rows = segments.select("transcript_id", "idx", "text", line.alias("line"), F.to_json(F.struct("start_s", "end_s", "text")).alias("json"))
    per = rows.groupBy("transcript_id").agg(ordered("text", "\n").alias("txt"), ordered("line", "\n").alias("segments"), F.concat(F.lit("["), ordered("json", ","), F.lit("]")).alias("json"))
    per = per.join(segments_to_markdown(segments).withColumnRenamed("markdown", "md"), "transcript_id")
    return per.unpivot("transcript_id", ["txt", "segments", "json", "md"], "format", "content")


def plain_markdown(markdown):
    """Markdown without heading and quote marks, bold and code."""
    text = F.regexp_replace(markdown, r"(?m)^[#>]+\s*", "")
    return F.regexp_replace(F.regexp_replace(text, r"\*\*(.+?)\*\*", "$1"), r"`([^`]*)`", "$1")


def summary_exports(summaries: DataFrame) -> DataFrame:
    return summaries.select("id", F.col("markdown").alias("md"), plain_markdown(F.col("markdown")).alias("txt")).unpivot("id", ["md", "txt"], "format", "content")


def dump(lectures: DataFrame) -> DataFrame:
    """path, content for chosen lectures (course, title, transcript_id, content and, where there is one, summary): one
    folder each with transcript.md and summary.md; clashing names get -2, -3.

    A generated name can clash with a real one; those get a second number.
    """
    named = lectures.withColumn("__slug", file_slug(F.col("title")))
    numbered = lambda df, by: df.withColumn("__n", F.row_number().over(Window.partitionBy("course", by).orderBy("transcript_id")))
    suffix = lambda c: F.when(F.col("__n") > 1, F.concat(F.col(c), F.lit("-"), F.col("__n").cast("string"))).otherwise(F.col(c))
    once = numbered(named, "__slug").withColumn("__slug", suffix("__slug")).drop("__n")
    twice = numbered(once, "__slug").withColumn("__slug", suffix("__slug"))
    files = {"transcript.md": F.col("content")} | ({"summary.md": F.col("summary")} if "summary" in lectures.columns else {})
    each = F.array(*[F.struct(F.lit(name).alias("name"), body.alias("content")) for name, body in files.items()])
    out = twice.select(F.concat_ws("/", file_slug(F.col("course")), "__slug").alias("folder"), F.explode(each).alias("f"))
    return out.select(F.concat_ws("/", "folder", "f.name").alias("path"), "f.content").where("content is not null")


def write_text(table: DataFrame, path: str, by: list[str]) -> None:
    """One text column, partitioned by the others."""
    table.write.mode("overwrite").partitionBy(*by).text(path)
