"""What a model is given to read: notes of a course, slides of a lecture, passages for a question, each within its budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fmt_ts
from .joins import budget_prefix, manual_over_auto


def in_order(order: list[str], text: Column, glue: str) -> Column:
    """An aggregate: texts in order, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("__t")))), lambda x: x["__t"]), glue)


def page_block(per_page: int | None = None) -> Column:
    """A page under its deck and number, in single spaces."""
    body = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t]+", " "))
    body = body if per_page is None else F.substring(body, 1, per_page)
    return F.when(body != "", F.concat(F.lit("["), "deck", F.lit(" p."), F.col("page_no").cast("string"), F.lit("]\n"), body))


def lecture_notes(summarised: DataFrame, chars: int = 9000) -> DataFrame:
    """project_id, notes, n_lectures of lectures (project_id, lecture_no, label, title, markdown) in order, each cut to ``chars``."""
    note = F.concat(F.lit('<lecture id="'), "label", F.lit('" title="'), "title", F.lit('">\n'), F.substring(F.coalesce("markdown", F.lit("")), 1, chars), F.lit("\n</lecture>"))
    return summarised.groupBy("project_id").agg(in_order(["lecture_no"], note, "\n\n").alias("notes"), F.count(F.lit(1)).alias("n_lectures"))


def slide_excerpts(linked: DataFrame, budget: int = 6000, per_page: int = 1200) -> DataFrame:
    """transcript_id, slides, n_pages: the pages of a lecture by rank while they fit; confirmed links before all others."""
    blocks = manual_over_auto(linked).withColumn("block", page_block(per_page)).where("block is not null").withColumn("len", F.length("block"))
    kept = budget_prefix(blocks, "transcript_id", ["rank"], budget)
    return kept.groupBy("transcript_id").agg(in_order(["rank"], F.col("block"), "\n\n").alias("slides"), F.count(F.lit(1)).alias("n_pages"))


def summary_context(lectures: DataFrame, courses: DataFrame, previous: DataFrame, terms: DataFrame, linked: DataFrame, most_pairs: int = 60) -> DataFrame:
    """Per lecture: its course's name, up to 60 automatic spellings, titles of the lectures before it, excerpts of its slides."""
    pair = F.concat(F.col("find"), F.lit(" = "), F.col("repl"))
    first = terms.where("auto = 1").withColumn("__n", F.row_number().over(Window.orderBy("find", "id"))).where(F.col("__n") <= most_pairs)  # a glossary, not a corpus
    glossary = first.agg(in_order(["find", "id"], pair, "; ").alias("glossary"))
    before = previous.groupBy("transcript_id").agg(in_order(["rank"], F.col("prev_title"), "\n").alias("previous"))
    out = lectures.select("project_id", "transcript_id").join(courses, "project_id", "left").join(before, "transcript_id", "left").join(slide_excerpts(linked), "transcript_id", "left")
    return out.crossJoin(F.broadcast(glossary)).select(  # one row
        "transcript_id", F.coalesce("course_name", F.lit("")).alias("course"), F.coalesce("previous", F.lit("")).alias("previous"), "glossary",
        F.coalesce("slides", F.lit("")).alias("slides"), F.coalesce("n_pages", F.lit(0)).cast("long").alias("n_pages"),
    )


def guide_context(notes: DataFrame, exams: DataFrame, budget: int = 40_000) -> DataFrame:
    """Per course with a summary or an exam: the notes of its lectures, and exam pages in order while they fit."""
    blocks = exams.withColumn("block", page_block()).where("block is not null").withColumn("len", F.length("block"))
    kept = budget_prefix(blocks, "project_id", ["deck", "page_no"], budget).groupBy("project_id")
    found = kept.agg(in_order(["deck", "page_no"], F.col("block"), "\n\n").alias("exams"), F.count(F.lit(1)).alias("n_pages"))
    return notes.join(found, "project_id", "full").select(
        "project_id", F.coalesce("notes", F.lit("")).alias("notes"), F.coalesce("n_lectures", F.lit(0)).cast("long").alias("n_lectures"),
        F.coalesce("exams", F.lit("")).alias("exams"), F.coalesce("n_pages", F.lit(0)).cast("long").alias("n_pages"),
    )


def answer_context(questions: DataFrame, passages: DataFrame, notes: DataFrame) -> DataFrame:
    """Per question of a course with notes: the notes, then the passages in order, each under its label and time, and the labels that they cite."""
    line = F.concat(F.lit("["), "label", F.lit(" "), fmt_ts(F.col("start_s")), F.lit("] "), "text")
    found = passages.groupBy("query_id").agg(in_order(["place"], line, "\n").alias("passages"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("sources"))
    asked = questions.select("project_id", "query_id").join(notes.select("project_id", "notes"), "project_id").join(found, "query_id", "left")
    return asked.select("query_id", F.concat_ws("\n\n", "notes", "passages").alias("context"), F.coalesce("sources", F.lit("")).alias("sources"))
