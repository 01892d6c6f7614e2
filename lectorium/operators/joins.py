"""Joins of links, pages, texts and jobs; anti-joins for what is missing, stale or orphaned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def link_pages_join(links: DataFrame, pages: DataFrame, stretch: int = 64) -> DataFrame:
    """Pages inside the range of a link of their deck, ranked per lecture: manual first, best score, deck, place.

    A link meets the stretches of ``stretch`` pages that its range touches, not all pages of its deck. Ranges are cut to the
    pages that the deck has beforehand.
    """
    of = lambda page: F.floor(page / stretch)
    ends = pages.groupBy("deck").agg(F.min("page_no").alias("__least"), F.max("page_no").alias("__most"))
    lo, hi = F.greatest("page_from", "__least"), F.least("page_to", "__most")
    cut = links.where("page_from <= page_to").join(ends, "deck").where(lo <= hi)
    cut = cut.withColumn("__stretch", F.explode(F.sequence(of(lo), of(hi)))).drop("__least", "__most")
    p = pages.select("deck", "page_no", "text", "kind", of(F.col("page_no")).alias("__stretch"))
    joined = cut.join(p, ["deck", "__stretch"]).where("page_no between page_from and page_to").drop("__stretch")
    w = Window.partitionBy("transcript_id").orderBy(F.col("link_source") != "manual", F.desc("score"), "deck", "page_from", "page_no", "id")
    return joined.withColumn("rank", F.row_number().over(w))


def link_listing(links: DataFrame, pages: DataFrame, lectures: DataFrame, titles: DataFrame) -> DataFrame:
    first = pages.select("deck", F.col("page_no").alias("page_from"), F.col("text").alias("first_text"))
    return links.join(lectures.select("transcript_id"), "transcript_id").join(titles, "transcript_id").join(first, ["deck", "page_from"], "left")


def manual_over_auto(linked: DataFrame) -> DataFrame:
    """Only confirmed links where a lecture has any; ``n_ignored`` says how many automatic rows that leaves out."""
    w = Window.partitionBy("transcript_id")
    manual = F.col("link_source") == "manual"
    marked = linked.select("*", F.max(manual).over(w).alias("__any"), F.count_if(~manual).over(w).alias("__auto"))
    kept = marked.where(manual | ~F.col("__any"))
    return kept.withColumn("n_ignored", F.when(F.col("__any"), F.col("__auto")).otherwise(0)).drop("__any", "__auto")


def budget_prefix(blocks: DataFrame, key: str, order: list[str], budget: int, used: int | Column = 0) -> DataFrame:
    """Blocks (with ``len``) in order while all up to them fit; the first that does not fit ends the list.

    used: what is taken of the budget beforehand, for all keys or as a column."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("used", F.lit(used) + F.sum("len").over(w)).where(F.col("used") <= budget)


def lectures_with_latest_summary(lectures: DataFrame, summaries: DataFrame, numbers: DataFrame) -> DataFrame:
    newest = summaries.groupBy("transcript_id").agg(F.max("id").alias("summary_id"), F.max_by("title", F.struct("id", "title")).alias("title"))
    return lectures.select("project_id", "transcript_id").join(newest, "transcript_id").join(numbers.select("transcript_id", "label"), "transcript_id")


def exam_pages(pages: DataFrame) -> DataFrame:
    return pages.where("kind = 'exam'")


def text_sha(text: str):
    return F.substring(F.sha2(F.col(text), 256), 1, 16)


def stale_vectors(texts: DataFrame, vectors: DataFrame, min_chars: int = 40) -> DataFrame:
    """Texts that are long enough and whose key and content have no stored vector."""
    hashed = texts.where(F.length("text") >= min_chars).withColumn("source_sha", text_sha("text"))
    return hashed.join(vectors.select("ref_id", "source_sha"), ["ref_id", "source_sha"], "left_anti")


def pending_inputs(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def duplicate_inputs(sources: DataFrame, scope: str, order: str) -> DataFrame:
    """Later inputs of a scope whose first MiB and size are those of an earlier one, which ``duplicate_of`` names."""
    raw = F.col("content").cast("binary")
    keyed = sources.select(scope, order, F.sha2(F.substring(raw, 1, 1 << 20), 256).alias("sha"), F.octet_length(raw).alias("bytes"))
    first = keyed.groupBy(scope, "sha", "bytes").agg(F.min(order).alias("duplicate_of"))
    return keyed.join(first, [scope, "sha", "bytes"]).where(F.col(order) != F.col("duplicate_of"))


def followups_due(pages: DataFrame, jobs: DataFrame, kind: str = "llm_fix") -> DataFrame:
    """Courses with a slide deck and without an active job of the kind."""
    decks = pages.where("kind = 'slides'").select("project_id").distinct()
    active = jobs.where((F.col("kind") == kind) & F.col("status").isin("queued", "running")).select("project_id").distinct()
    return decks.join(active, "project_id", "left_anti")


def orphans_cascade(children: DataFrame, parents: DataFrame, key: str, set_null: bool = False) -> DataFrame:
    """Children of parents that are still there; or all children, with the key nulled where the parent is gone."""
    alive = parents.select(key).distinct()
    if not set_null:
        return children.join(alive, key, "left_semi")
    marked = children.join(alive.withColumn("__alive", F.lit(True)), key, "left")
    return marked.withColumn(key, F.when(F.col("__alive"), F.col(key))).drop("__alive")
