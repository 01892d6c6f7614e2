"""Table upkeep: upserts, replacements and fingerprints, as new tables or written to stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshots import BucketTable


def refresh_auto_links(current: DataFrame, fresh: DataFrame, decks: DataFrame) -> DataFrame:
    """Links after new automatic ranges of ``decks``: confirmed rows stay, and win over a new row of the same range."""
    key = ["deck", "page_from", "page_to"]
    manual = current.where("link_source = 'manual'")
    elsewhere = current.where("link_source <> 'manual'").join(decks, "deck", "left_anti")
    new = fresh.join(decks, "deck", "left_semi").join(manual.select(*key), key, "left_anti").withColumn("link_source", F.lit("auto"))
    return manual.unionByName(elsewhere).unionByName(new.select(*current.columns))


def upsert_keyed(current: DataFrame, changes: DataFrame, key: list[str], order: str, keep: list[str] = ()) -> DataFrame:
    """Last write wins per key; columns in ``keep`` take the newest value that is not null."""
    every = current.unionByName(changes)
    rest = [c for c in current.columns if c not in key]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) if c in keep else F.max_by(c, order).alias(c) for c in rest if c != order]
    return every.groupBy(*key).agg(*newest, F.max(order).alias(order)).select(*current.columns)


def accept_links(links: DataFrame, accepted: DataFrame) -> DataFrame:
    """Links with those whose id is among ``accepted`` (column id) confirmed."""
    marked = links.join(accepted.select("id").distinct().withColumn("__ok", F.lit(True)), "id", "left")
    return marked.withColumn("link_source", F.when(F.col("__ok"), "manual").otherwise(F.col("link_source"))).drop("__ok")


def replace_generated_cards(cards: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cards after a run: those of its lectures that nobody edited go, unless the run brought nothing for the lecture."""
    touched = fresh.select("transcript_id").distinct()
    kept = cards.join(touched.withColumn("__new", F.lit(True)), "transcript_id", "left").where("edited or __new is null").drop("__new")
    return kept.unionByName(fresh.select(*cards.columns))


def existing_fronts(cards: DataFrame) -> DataFrame:
    """Fronts that a new run of a course must not repeat: project_id, front, except_transcript_id.

    A lecture may repeat the fronts that only it has, unless they were edited; it is named in the last column, which is
    null otherwise. One row per front, so the result does not grow with lectures times fronts.
    """
    own = F.when(F.bool_or("edited") | (F.min("transcript_id") != F.max("transcript_id")), None).otherwise(F.min("transcript_id"))
    return cards.groupBy("project_id", "front").agg(own.alias("except_transcript_id"))


def mark_interrupted(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("status") == "running", "interrupted").when(F.col("status") == "parsing", "error").otherwise(F.col("status")))


def cache_check(contexts: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """The fingerprint of each context (all other columns) and whether the last good run had the same."""
    inputs = sorted(c for c in contexts.columns if c != key)
    hashed = contexts.select(key, F.sha2(F.to_json(F.struct(*inputs)), 256).alias("fingerprint"))
    w = Window.partitionBy(key).orderBy(F.desc("run_id"))
    last = runs.where("status = 'ok'").withColumn("__n", F.row_number().over(w)).where("__n = 1").select(key, F.col("fingerprint").alias("__last"))
    return hashed.join(last, key, "left").select(key, "fingerprint", F.coalesce(F.col("fingerprint") == F.col("__last"), F.lit(False)).alias("cached"))


def write_upserts(table: BucketTable, changes: DataFrame, key: list[str], order: str, keep: list[str] = (), tag: tuple[str, int] | None = None) -> bool:
    """``upsert_keyed`` on a stored table whose bucket key is among ``key``: only the buckets of changed keys are read and written."""
    return table.change(changes, lambda current: upsert_keyed(current, changes.select(*current.columns), key, order, keep), tag)


def write_auto_links(table: BucketTable, fresh: DataFrame, decks: DataFrame, tag: tuple[str, int] | None = None) -> bool:
    """``refresh_auto_links`` on stored links in buckets of decks."""
    return table.change(decks, lambda current: refresh_auto_links(current, fresh, decks), tag)


def write_generated_cards(table: BucketTable, fresh: DataFrame, tag: tuple[str, int] | None = None) -> bool:
    """``replace_generated_cards`` on stored cards in buckets of lectures."""
    return table.change(fresh, lambda current: replace_generated_cards(current, fresh), tag)
