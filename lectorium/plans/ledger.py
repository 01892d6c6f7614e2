"""Queries of the cost ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as op
from ..registry import query

UNCOVERED = """SELECT s.* FROM summaries s ANTI JOIN (SELECT id AS job_id FROM jobs
  WHERE kind = 'llm_summary' AND tokens_in + tokens_out + cache_hit > 0) costing USING (job_id)"""
ALL_TOKENS = "sum(tokens_in + tokens_out + cache_hit)"
LEDGER = f"""ledger AS (
  SELECT project_id, strftime(finished_at, '%Y-%m') AS month, kind, sum(cost_micro) AS cost_micro, {ALL_TOKENS} AS tokens, count(*) AS n_jobs
  FROM jobs WHERE kind IN ('llm_summary', 'llm_fix', 'llm_cards', 'llm_guide') AND finished_at IS NOT NULL GROUP BY ALL
  UNION ALL SELECT l.project_id, strftime(u.created_at, '%Y-%m'), 'llm_summary', sum(cost_micro), {ALL_TOKENS}, count(*)
  FROM ({UNCOVERED}) u JOIN lectures l USING (transcript_id) GROUP BY ALL
  UNION ALL SELECT project_id, strftime(created_at, '%Y-%m'), 'llm_ask', sum(cost_micro), sum(tokens_in + tokens_out), count(*) FROM questions GROUP BY ALL)"""
LONG = lambda c: f"CAST(sum({c}) AS BIGINT) AS {c}"
CELLS = f"{LEDGER}, cells AS (SELECT project_id, month, kind, {LONG('cost_micro')}, {LONG('tokens')}, {LONG('n_jobs')} FROM ledger GROUP BY ALL)"
TOTALS = """CAST(sum(cost_micro) AS BIGINT) AS total, CAST(sum(CASE WHEN kind = 'llm_summary' THEN cost_micro ELSE 0 END) AS BIGINT) AS summary,
  CAST(sum(cost_micro) - sum(CASE WHEN kind = 'llm_summary' THEN cost_micro ELSE 0 END) AS BIGINT) AS other, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(n_jobs) AS BIGINT) AS n_jobs"""


def cells(v):
    return op.cost_cells(v["jobs"], v["summaries"], v["lectures"], v["questions"])


@query("uncovered_summaries", UNCOVERED)
def _(v):
    return op.uncovered_summaries(v["summaries"], v["jobs"]).select(*v["summaries"].columns)


@query("union_ledger", f"WITH {LEDGER} SELECT project_id, month, kind, CAST(cost_micro AS BIGINT) AS cost_micro, CAST(tokens AS BIGINT) AS tokens, n_jobs FROM ledger")
def _(v):
    return op.union_ledger(v["jobs"], v["summaries"], v["lectures"], v["questions"])


@query("cost_cells", f"WITH {CELLS} SELECT * FROM cells")
def _(v):
    return cells(v)


@query("cost_by_course", f"""WITH {CELLS}, per AS (SELECT project_id, {TOTALS} FROM cells WHERE kind <> 'llm_ask'
  GROUP BY project_id) SELECT *, round(total / (max(total) OVER ()), 6) AS share FROM per WHERE total > 0""")
def _(v):
    return op.cost_by_course(cells(v).where("kind <> 'llm_ask'"))


@query("cost_cube", f"WITH {CELLS} SELECT project_id, month, kind, {TOTALS} FROM cells GROUP BY GROUPING SETS ((project_id, month, kind), (project_id, month), (project_id, kind), (project_id))")
def _(v):
    return op.cost_cube(cells(v))


@query("month_budget", f"WITH {CELLS} SELECT month, CAST(sum(cost_micro) AS BIGINT) AS cost_micro, sum(cost_micro) > 20000000 AS over_budget FROM cells GROUP BY month")
def _(v):
    return op.month_budget(cells(v), 20_000_000)


@query("costs", f"WITH {CELLS} SELECT month, kind, CAST(sum(cost_micro) AS BIGINT) AS cost_micro, CAST(count(DISTINCT project_id) AS BIGINT) AS n_courses FROM cells GROUP BY ALL")
def _(v):
    return cells(v).groupBy("month", "kind").agg(F.sum("cost_micro").alias("cost_micro"), F.countDistinct("project_id").alias("n_courses"))


@query("usage_totals", """WITH calls AS (SELECT l_orderkey AS job_id, CAST(l_partkey AS BIGINT) * 100 AS prompt, CAST(l_suppkey AS BIGINT) AS hit,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey AS BIGINT) * 3 END AS miss, CAST(l_linenumber AS BIGINT) * 50 AS o FROM lineitem),
t AS (SELECT job_id, sum(prompt) AS prompt, sum(hit) AS hit, sum(coalesce(miss, greatest(0, prompt - hit))) AS miss, sum(o) AS o FROM calls GROUP BY job_id)
SELECT job_id, CAST(prompt AS BIGINT) AS prompt, CAST(hit AS BIGINT) AS hit, CAST(miss AS BIGINT) AS miss, CAST(o AS BIGINT) AS out,
  round((CAST(hit AS DOUBLE) * 0.003::DOUBLE + CAST(miss AS DOUBLE) * 0.15::DOUBLE + CAST(o AS DOUBLE) * 0.6::DOUBLE) / 1000000, 6) AS cost FROM t""")
def _(v):
    calls = v["lineitem"].selectExpr(
        "l_orderkey as job_id", "cast(l_partkey as bigint) * 100 as prompt", "cast(l_suppkey as bigint) as hit",
        "case when l_linenumber % 2 = 0 then cast(l_partkey as bigint) * 3 end as miss", "cast(l_linenumber as bigint) * 50 as out")
    return op.usage_totals(calls, "job_id")
