"""Cost ledger: what models cost, by course, month and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAID_KINDS = ["llm_summary", "llm_fix", "llm_cards", "llm_guide"]
#: Dollars per million tokens, as the price list has them (fixed values).
RATES = {"cache_hit": 0.003, "cache_miss": 0.15, "output": 0.60}


def month_of(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def used_tokens(df: DataFrame) -> Column:
    """All tokens of a row: read, written, and read from a cache where that is recorded."""
    return sum(F.coalesce(F.col(c), F.lit(0)) for c in ("tokens_in", "tokens_out", "cache_hit") if c in df.columns)


def _cells(df: DataFrame, ts: str, kind: Column) -> DataFrame:
    keyed = df.select("project_id", month_of(ts).alias("month"), kind.alias("kind"), "cost_micro", used_tokens(df).alias("tokens"))
    return keyed.groupBy("project_id", "month", "kind").agg(
        F.sum("cost_micro").alias("cost_micro"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_jobs")
    )


def uncovered_summaries(summaries: DataFrame, jobs: DataFrame) -> DataFrame:
    """Summaries whose own job recorded no tokens; those without a job are among them."""
    costing = jobs.where((F.col("kind") == "llm_summary") & (used_tokens(jobs) > 0)).select(F.col("id").alias("job_id"))
    return summaries.join(costing, "job_id", "left_anti")


def union_ledger(jobs: DataFrame, summaries: DataFrame, lectures: DataFrame, questions: DataFrame) -> DataFrame:
    """Cells of the three sources of cost, one after another."""
    paid = _cells(jobs.where(F.col("kind").isin(PAID_KINDS) & F.col("finished_at").isNotNull()), "finished_at", F.col("kind"))
    rest = uncovered_summaries(summaries, jobs).join(lectures.select("transcript_id", "project_id"), "transcript_id")
    return paid.unionByName(_cells(rest, "created_at", F.lit("llm_summary"))).unionByName(_cells(questions, "created_at", F.lit("llm_ask")))


def cost_cells(jobs: DataFrame, summaries: DataFrame, lectures: DataFrame, questions: DataFrame) -> DataFrame:
    ledger = union_ledger(jobs, summaries, lectures, questions)
    return ledger.groupBy("project_id", "month", "kind").agg(*[F.sum(c).alias(c) for c in ("cost_micro", "tokens", "n_jobs")])


def _totals() -> list[Column]:
    summary = F.sum(F.when(F.col("kind") == "llm_summary", F.col("cost_micro")).otherwise(0))
    return [F.sum("cost_micro").alias("total"), summary.alias("summary"), (F.sum("cost_micro") - summary).alias("other"), F.sum("tokens").alias("tokens"), F.sum("n_jobs").alias("n_jobs")]


def cost_by_course(cells: DataFrame, month: str | None = None, kind: str | None = None) -> DataFrame:
    """Totals per course under optional filters; courses that cost nothing are left out; share is of the dearest."""
    if month is not None:
        cells = cells.where(F.col("month") == month)
    if kind is not None:
        cells = cells.where(F.col("kind") == kind)
    per = cells.groupBy("project_id").agg(*_totals()).where("total > 0")
    dearest = per.agg(F.max("total").alias("__most"))
    return per.crossJoin(F.broadcast(dearest)).withColumn("share", F.round(F.col("total") / F.col("__most"), 6)).drop("__most")


def cost_cube(cells: DataFrame) -> DataFrame:
    """The same totals for every choice of the two menus; null stands for all months or all kinds."""
    return cells.groupingSets([["project_id", "month", "kind"], ["project_id", "month"], ["project_id", "kind"], ["project_id"]], "project_id", "month", "kind").agg(*_totals())


def month_budget(cells: DataFrame, budget_micro: int) -> DataFrame:
    spent = cells.groupBy("month").agg(F.sum("cost_micro").alias("cost_micro"))
    return spent.withColumn("over_budget", F.col("cost_micro") > budget_micro)


def estimate_cost(hit: Column, miss: Column, out: Column) -> Column:
    """Dollars, rounded to six digits; null when no tokens are known at all."""
    hit, miss, out = (F.coalesce(c, F.lit(0)) for c in (hit, miss, out))
    cost = (hit * RATES["cache_hit"] + miss * RATES["cache_miss"] + out * RATES["output"]) / 1_000_000
    return F.when(hit + miss + out > 0, F.round(cost, 6))


def token_usage(prompt: Column, hit: Column, miss: Column) -> Column:
    """Cache misses: as given, else what of the prompt did not hit."""
    return F.coalesce(miss, F.greatest(F.lit(0), F.coalesce(prompt, F.lit(0)) - F.coalesce(hit, F.lit(0))))


def usage_totals(calls: DataFrame, key: str) -> DataFrame:
    """Tokens of all calls of a job and what they cost (columns prompt, hit, miss, out)."""
    filled = calls.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("prompt", "hit", "out")], token_usage(F.col("prompt"), F.col("hit"), F.col("miss")).alias("miss"))
    totals = filled.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("prompt", "hit", "miss", "out")])
    return totals.withColumn("cost", estimate_cost(F.col("hit"), F.col("miss"), F.col("out")))


