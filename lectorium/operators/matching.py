"""Slide pages to lectures: similarity join, best match, runs, smoothing, ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dot, unit
from ..sources.folders import materialised
from .joins import stale_vectors
from .upkeep import refresh_auto_links

PAGE = ["deck", "page_no"]


def nearest_lecture_join(pages: DataFrame, lectures: DataFrame) -> DataFrame:
    """Score of every page against every lecture of its course (columns project_id, vec and their keys)."""
    a = pages.select("project_id", *PAGE, unit(F.col("vec")).alias("__page"))
    b = lectures.select("project_id", "transcript_id", unit(F.col("vec")).alias("__lecture"))
    return a.join(b, "project_id").select("project_id", *PAGE, "transcript_id", dot(F.col("__page"), F.col("__lecture")).alias("score"))


def top_lectures(pages: DataFrame, lectures: DataFrame, k: int, block: int = 2048, tile: int = 2048) -> DataFrame:
    """The k best lectures of every page of its course: project_id, page, transcript_id, score, rank; ties to the smaller id.

    The pages of a course lie in blocks and its lectures in tiles, as many of each as their numbers ask for. A block and a
    tile meet in one task as a product of two matrices that gives each page's k best of the tile; the best of all tiles
    are ranked. No other pair of a page and a lecture becomes a row. Vectors that are null or zero take no part.
    """
    # equal numbers of different types have different hashes, so both sides need one type to meet in a task
    own_course = pages.schema["project_id"].dataType
    course = pages.select("project_id").union(lectures.select("project_id")).schema["project_id"].dataType
    pages, lectures = (df.withColumn("project_id", F.col("project_id").cast(course)) for df in (pages, lectures))
    usable = lambda df: df.where(F.col("project_id").isNotNull() & F.exists("vec", lambda x: x != 0))
    dealt = lambda df, size, name: df.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = dealt(pages, block, "blocks").join(dealt(lectures, tile, "tiles"), "project_id")  # courses that have both
    own = lambda n, *key: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vec = F.col("vec").cast("array<double>").alias("vec")
    named = lambda *columns: [F.col(c).alias(c) for c in columns]  # noqa: E731  names of their own: both sides may come from one table
    a = usable(pages).join(sizes, "project_id").select(*named("project_id", *PAGE), vec, own("blocks", *PAGE).alias("block"), every("tiles").alias("tile"))
    b = usable(lectures).join(sizes, "project_id").select(*named("project_id", "transcript_id"), vec, own("tiles", "transcript_id").alias("tile"), every("blocks").alias("block"))

    def best(mine: pa.Table, others: pa.Table) -> pa.Table:
        others = others.sort_by("transcript_id")
        x, y = (_units(t["vec"]) for t in (mine, others))
        many = min(k, len(y)) if len(x) else 0
        scores = x @ y.T if many else np.zeros((0, 0))
        first = np.argsort(-scores, axis=1, kind="stable")[:, :many]
        rows = pa.array(np.repeat(np.arange(len(scores)), many))
        ids = others["transcript_id"].take(pa.array(first.ravel()))
        found = mine.select(["project_id", *PAGE]).take(rows).append_column("transcript_id", ids)
        return found.append_column("score", pa.array(np.take_along_axis(scores, first, 1).ravel()))

    kinds = {**{c: a.schema[c] for c in ("project_id", *PAGE)}, "transcript_id": b.schema["transcript_id"]}
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in kinds.items()) + ", score double"
    key = ["project_id", "block", "tile"]
    met = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(best, schema)
    return vector_topk(met.withColumn("project_id", F.col("project_id").cast(own_course)), k)


def _units(column: pa.ChunkedArray) -> np.ndarray:
    x = column.combine_chunks().flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vector_topk(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("project_id", *PAGE).orderBy(F.desc("score"), "transcript_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_page_match(scores: DataFrame, pages: DataFrame, threshold: float = 0.60, margin: float = 0.02) -> DataFrame:
    """One row per page of ``pages``: its lecture, or null where no score is high or clear enough, and the score.

    Of ``scores`` the two best of a page are enough. Best and second start from zero, so a negative score never counts; a page without a score gets (null, 0).
    """
    w = Window.partitionBy("project_id", *PAGE).orderBy(F.desc("score"), "transcript_id")
    top = scores.select("*", F.row_number().over(w).alias("__n"), F.lead("score").over(w).alias("__next")).where("__n = 1")
    best, second = F.greatest("score", F.lit(0.0)), F.greatest(F.coalesce("__next", F.lit(0.0)), F.lit(0.0))
    clear = (best >= threshold) & ((best - second >= margin) if margin > 0 else F.lit(True)) & (best > 0)
    top = top.select(*PAGE, F.when(clear, F.col("transcript_id")).alias("transcript_id"), F.round(best, 4).alias("score"))
    return pages.select(*PAGE).join(top, PAGE, "left").select(*PAGE, "transcript_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def with_runs(pages: DataFrame) -> DataFrame:
    """Adds ``run``: pages of a deck with the same lecture (null counts as a lecture) in unbroken sequence share it."""
    w = Window.partitionBy("deck").orderBy("page_no")
    fresh = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.lag("transcript_id").over(w).eqNullSafe(F.col("transcript_id"))).cast("int"))
    return pages.withColumn("__fresh", fresh).withColumn("run", F.sum("__fresh").over(w)).drop("__fresh")


def mean4(score: str) -> Column:
    """Mean of scores of four digits, rounded to four digits; in whole numbers, so that ties round alike everywhere."""
    total, n = F.sum(F.round(F.col(score) * 10_000).cast("long")), F.count(score)
    return F.floor((2 * total + n) / (2 * n)) / 10_000


def runs(pages: DataFrame) -> DataFrame:
    return (
        with_runs(pages)
        .groupBy("deck", "run")
        .agg(
            F.min("page_no").alias("page_from"),
            F.max("page_no").alias("page_to"),
            F.first("transcript_id").alias("transcript_id"),
            mean4("score").alias("score"),
            F.count(F.lit(1)).alias("n_pages"),
            F.max("score").alias("top_score"),
        )
    )


def smooth_runs(pages: DataFrame, min_run: int = 3, fill_none_below: float | None = None) -> DataFrame:
    """Relabel runs shorter than ``min_run`` from their neighbours in the original sequence.

    A hole takes the lecture that its nearest assigned neighbours on both sides share, or that of its only side if
    it resembles something; a hole with a score of ``fill_none_below`` or more is ambiguous and stays. An assigned
    run between two assigned runs takes their common lecture, or none if they differ. Relabelled pages get the mean
    score of their run.
    """
    w = Window.partitionBy("deck").orderBy("run")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    own = F.col("transcript_id")
    r = runs(pages).select(
        "*",
        F.last("transcript_id", ignorenulls=True).over(before).alias("__left"),
        F.first("transcript_id", ignorenulls=True).over(after).alias("__right"),
        F.lag("transcript_id").over(w).alias("__previous"),
        F.lead("transcript_id").over(w).alias("__next"),
    )
    left, right, previous, following = (F.col(c) for c in ("__left", "__right", "__previous", "__next"))
    ambiguous = F.lit(False) if fill_none_below is None else F.col("top_score") >= fill_none_below
    hole = F.when(left.isNotNull() & (left == right) & ~ambiguous, left).when(
        (left.isNull() != right.isNull()) & (F.col("score") > 0) & ~ambiguous, F.coalesce(left, right)
    )
    inside = previous.isNotNull() & following.isNotNull()
    target = (
        F.when(F.col("n_pages") >= min_run, own)
        .when(own.isNull(), hole)
        .when(inside, F.when(previous == following, previous))
        .otherwise(own)
    )
    r = r.select("deck", "run", target.alias("__target"), F.col("score").alias("__mean"))
    changed: Column = ~F.col("__target").eqNullSafe(own)
    return with_runs(pages).join(r, ["deck", "run"]).select(
        *PAGE, F.col("__target").alias("transcript_id"), F.when(changed, F.col("__mean")).otherwise(F.col("score")).alias("score")
    )


def page_ranges(pages: DataFrame) -> DataFrame:
    return runs(pages).where("transcript_id is not null").select("deck", "page_from", "page_to", "transcript_id", "score")


def match_pages(pages: DataFrame, lectures: DataFrame, threshold: float = 0.60, margin: float = 0.02, min_run: int = 3) -> DataFrame:
    """From vectors to the ranges of pages that belong to a lecture."""
    best = best_page_match(top_lectures(pages, lectures, 2), pages, threshold, margin)
    return page_ranges(smooth_runs(best, min_run, threshold))


def match_project(
    pages: DataFrame, lectures: DataFrame, texts: DataFrame, decks: DataFrame, current: DataFrame, threshold: float = 0.60, margin: float = 0.02, min_run: int = 3
) -> DataFrame:
    """The links of all courses after their slide decks have been matched: the columns of ``current``.

    Decks that are no slides, exams for one, are not matched and keep the links that they have. A page (project_id, deck,
    page_no, ref_id, source_sha, vec) whose vector is not of the text in ``texts`` (ref_id, text) would answer for an older
    one: it is matched like a page without a vector, so only its neighbours can place it. Confirmed links stay.
    """
    slides = decks.where("kind = 'slides'").select("deck")
    mine = materialised(pages.join(slides, "deck", "left_semi"))
    old = stale_vectors(texts, mine.select("ref_id", "source_sha")).select("ref_id").distinct().withColumn("__old", F.lit(True))
    known = mine.join(old, "ref_id", "left").withColumn("vec", F.when(F.col("__old").isNull(), F.col("vec")))
    fresh = match_pages(known.select("project_id", *PAGE, "vec"), lectures, threshold, margin, min_run)
    return refresh_auto_links(current, fresh.withColumn("link_source", F.lit("auto")), slides)
