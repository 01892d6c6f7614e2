"""Listings: one row per course, deck, lecture or job, from children that are aggregated once each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The whole newest row of every key; ``order`` ends in a unique column."""
    rest = [c for c in df.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*key).agg(newest).select(*key, "__row.*")


def short_title(title: Column) -> Column:
    """A title without the course's name before a dash."""
    rest = F.regexp_extract(title, r"^.+?\s+[–—]\s+(.+)$", 1)
    return F.coalesce(F.nullif(rest, F.lit("")), title)


def display_title(lectures: DataFrame, summaries: DataFrame) -> DataFrame:
    """The short title of the newest summary that has one, else the lecture's own."""
    newest = latest_per_key(summaries.where("title <> ''"), ["transcript_id"], ["created_at", "id"]).select("transcript_id", "title")
    own = F.concat(F.lit("Lecture "), F.col("transcript_id").cast("string"))
    return lectures.join(newest, "transcript_id", "left").select("transcript_id", F.coalesce(short_title(F.col("title")), own).alias("display_title"))


def lecture_numbers(lectures: DataFrame) -> DataFrame:
    w = Window.partitionBy("project_id").orderBy("created_at", "transcript_id")
    n = F.row_number().over(w)
    return lectures.select("project_id", "transcript_id", n.alias("lecture_no"), F.concat(F.lit("L"), n.cast("string")).alias("label"))


def upper_median(values: Column) -> Column:
    """The middle of the sorted values, the upper one of two."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def low_coverage(lectures: DataFrame, min_minutes: float = 10.0, min_n: int = 3, ratio: float = 0.55) -> DataFrame:
    """Characters per minute of lectures that are long enough, their course's median rate, and who falls well below.

    The rates of a course are counted by value first, so what is gathered is bounded by the number of rates.
    """
    minutes = F.col("duration") / 60
    rate = F.when(minutes >= min_minutes, F.rint(F.col("chars") / minutes).cast("long"))
    rated = lectures.select("project_id", "transcript_id", rate.alias("chars_per_min"))
    counts = rated.where("chars_per_min > 0").groupBy("project_id", "chars_per_min").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("project_id").orderBy("chars_per_min")
    run = counts.select("*", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy("project_id")).alias("all"))
    middle = run.where((F.floor(F.col("all") / 2) >= F.col("upto") - F.col("n")) & (F.floor(F.col("all") / 2) < F.col("upto")) & (F.col("all") >= min_n))
    middle = middle.select("project_id", F.col("chars_per_min").alias("median"))
    flag = F.coalesce((F.col("chars_per_min") > 0) & (F.col("chars_per_min") < ratio * F.col("median")), F.lit(False))
    return rated.join(middle, "project_id", "left").select("project_id", "transcript_id", "chars_per_min", "median", flag.alias("low_coverage"))


def card_counts(cards: DataFrame, key: str = "transcript_id") -> DataFrame:
    return cards.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_cards"), F.count_if(F.col("status") == "active").alias("n_active"), F.count_if(F.col("status") == "suspended").alias("n_suspended")
    )


def lecture_listing(lectures: DataFrame, summaries: DataFrame, cards: DataFrame, links: DataFrame) -> DataFrame:
    n_sum = summaries.groupBy("transcript_id").agg(
        F.count(F.lit(1)).alias("n_summaries"), F.max_by("id", F.struct("created_at", "id")).alias("summary_id"), F.max_by("title", F.struct("created_at", "id", "title")).alias("summary_title")
    )
    n_cards = card_counts(cards).select("transcript_id", "n_cards")
    n_links = links.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n_links"))
    numbers = lecture_numbers(lectures).drop("project_id", "label")
    flags = low_coverage(lectures).select("transcript_id", "chars_per_min", "low_coverage")
    out = lectures.select("project_id", "transcript_id", "chars")
    for child in (numbers, n_sum, n_cards, n_links, flags):
        out = out.join(child, "transcript_id", "left")
    return out.fillna(0, ["n_summaries", "n_cards", "n_links"])


def course_listing(courses: DataFrame, lectures: DataFrame, jobs: DataFrame) -> DataFrame:
    n_lectures = lectures.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_lectures"))
    n_ok = jobs.where("kind = 'transcribe' and status = 'done'").groupBy("project_id").agg(F.count(F.lit(1)).alias("n_ok_sources"))
    return courses.join(n_lectures, "project_id", "left").join(n_ok, "project_id", "left").fillna(0, ["n_lectures", "n_ok_sources"])


def deck_listing(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages, pages with little text, and links of every deck (columns deck, text)."""
    per = pages.groupBy("deck").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.length("text") < 300).alias("n_short"))
    n_links = links.groupBy("deck").agg(F.count(F.lit(1)).alias("n_links"))
    return per.join(n_links, "deck", "left").fillna(0, ["n_links"])


def job_listing(jobs: DataFrame, courses: DataFrame, summaries: DataFrame) -> DataFrame:
    titles = summaries.where("title <> ''").groupBy("transcript_id").agg(F.max_by("title", F.struct("id", "title")).alias("lecture_title"))
    return jobs.join(courses, "project_id", "left").join(titles, "transcript_id", "left")


STATUS_RANK = {"running": 4, "queued": 3, "failed": 2, "interrupted": 2}


def job_board(jobs: DataFrame) -> DataFrame:
    """Jobs by lecture (else by themselves): the last job of each kind, the most urgent status, the last id."""
    key = F.coalesce(F.concat(F.lit("t"), F.col("transcript_id").cast("string")), F.concat(F.lit("j"), F.col("id").cast("string")))
    last = jobs.withColumn("key", key).groupBy("key", "kind").agg(F.max("id").alias("id"), F.max_by("status", "id").alias("status"))
    rank = F.coalesce(*[F.when(F.col("status") == s, r) for s, r in STATUS_RANK.items()], F.lit(1))
    steps = last.withColumn("rank", rank)
    return steps.groupBy("key").agg(
        F.max_by("status", F.struct("rank", "id")).alias("status"), F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("status") == "done").alias("n_done"), F.max("id").alias("last_id")
    )


def queue_eta(running: DataFrame, queued: DataFrame, done: DataFrame) -> DataFrame:
    """Seconds until the queue of a course is empty: columns eta; kind, duration; id, speed. No row for an empty queue."""
    w = Window.partitionBy("project_id").orderBy(F.desc("id"))
    speed = done.where("speed > 0").withColumn("n", F.row_number().over(w)).where("n <= 10").groupBy("project_id").agg(F.avg("speed").alias("speed"))
    now = running.groupBy("project_id").agg(F.sum(F.coalesce("eta", F.lit(40.0))).alias("s"))
    step = (
        F.when(F.col("kind") == "transcribe", F.coalesce("duration", F.lit(0.0)) / F.coalesce("speed", F.lit(10.0)) + 20)
        .when(F.col("kind").startswith("llm"), 40.0)
        .otherwise(15.0)
    )
    later = queued.join(speed, "project_id", "left").groupBy("project_id").agg(F.sum(step).alias("s"))
    return now.union(later).groupBy("project_id").agg(F.round(F.sum("s"), 4).alias("eta_s"))


def throughput_report(results: DataFrame) -> DataFrame:
    """Per course: seconds of audio and of work, their ratio, and how many ended well (columns audio_s, elapsed_s, error)."""
    return results.groupBy("project_id").agg(
        F.round(F.sum("audio_s"), 4).alias("audio_s"),
        F.round(F.sum("elapsed_s"), 4).alias("elapsed_s"),
        F.round(F.try_divide(F.sum("audio_s"), F.sum("elapsed_s")), 4).alias("x_realtime"),
        F.count_if(F.col("error").isNull()).alias("n_ok"),
        F.count_if(F.col("error").isNotNull()).alias("n_error"),
    )


def study_progress(lectures: DataFrame, study: DataFrame) -> DataFrame:
    joined = lectures.join(study, "transcript_id", "left")
    done = F.count_if(F.col("study_status").isin("reviewed", "confident"))
    return joined.groupBy("project_id").agg(done.alias("n_done"), F.count(F.lit(1)).alias("n_lectures"), F.round(F.sum("duration"), 3).alias("duration"))


def dominant_language(docs: DataFrame, key: str, default: str = "en") -> DataFrame:
    counts = docs.where("lang is not null").groupBy(key, "lang").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("lang"))
    return docs.select(key).distinct().join(best, key, "left").select(key, F.coalesce("lang", F.lit(default)).alias("language"))


def previous_lectures(lectures: DataFrame, summaries: DataFrame, n: int = 5) -> DataFrame:
    """For each lecture, the newest n summaries of other lectures of its course.

    Each lecture's own newest n are known first: of the n newest of the course that are not its own, none can be
    older than the course's newest (n + own), so the course keeps only n of each lecture before the self-join.
    """
    mine = lectures.select("project_id", "transcript_id")
    w = Window.partitionBy("transcript_id").orderBy(F.desc("created_at"), F.desc("id"))
    newest = summaries.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).join(mine, "transcript_id")
    course = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("id"))
    top = newest.withColumn("__c", F.row_number().over(course)).where(F.col("__c") <= 2 * n)
    other = top.select("project_id", F.col("transcript_id").alias("other_id"), F.col("title").alias("prev_title"), "id", "created_at")
    pairs = mine.join(other, "project_id").where("transcript_id <> other_id")
    mine_first = Window.partitionBy("transcript_id").orderBy(F.desc("created_at"), F.desc("id"))
    return pairs.withColumn("rank", F.row_number().over(mine_first)).where(F.col("rank") <= n).select("transcript_id", "prev_title", "rank", F.col("id").alias("summary_id"))
