"""Queries of the page matching chain."""

from __future__ import annotations

from ..operators import matching as m
from ..registry import query

THRESHOLD, MARGIN = 0.45, 0.02

SCORES = """scores AS (SELECT p.project_id, p.deck, p.page_no, l.transcript_id,
    list_sum(list_transform(list_zip(p.vec, l.uv), lambda z: z[1] * z[2])) AS score
  FROM page_vectors p JOIN (SELECT project_id, transcript_id, list_transform(vec, lambda y: CAST(y AS DOUBLE) / sqrt(list_sum(list_transform(vec,
  lambda z: CAST(z AS DOUBLE) * z)))) AS uv FROM course_lecture_vectors) l USING (project_id))"""
BEST = f"""{SCORES},
ranked AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS nxt FROM scores
  WINDOW w AS (PARTITION BY project_id, deck, page_no ORDER BY score DESC, transcript_id)),
best AS (SELECT deck, page_no,
    CASE WHEN greatest(score, 0) >= {THRESHOLD} AND greatest(score, 0) - greatest(coalesce(nxt, 0), 0) >= {MARGIN} THEN transcript_id END AS transcript_id,
    round(greatest(score, 0), 4) AS score FROM ranked WHERE n = 1)"""


def runs_sql(source: str, name: str) -> str:
    return f"""{name}_pages AS (SELECT *, sum(fresh) OVER (PARTITION BY deck ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY deck ORDER BY page_no) = 1 THEN 0
      WHEN lag(transcript_id) OVER (PARTITION BY deck ORDER BY page_no) IS DISTINCT FROM transcript_id THEN 1 ELSE 0 END AS fresh FROM {source})),
{name} AS (SELECT deck, run, min(page_no) AS page_from, max(page_no) AS page_to, any_value(transcript_id) AS transcript_id,
    floor((2 * sum(CAST(round(score * 10000) AS BIGINT)) + count(score)) / (2.0 * count(score))) / 10000.0 AS score, count(*) AS n_pages, max(score) AS top_score
  FROM {name}_pages GROUP BY deck, run)"""


SMOOTHED = f"""{runs_sql("best", "r")},
near AS (SELECT *, last_value(transcript_id IGNORE NULLS) OVER (PARTITION BY deck ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lft,
    first_value(transcript_id IGNORE NULLS) OVER (PARTITION BY deck ORDER BY run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rgt,
    lag(transcript_id) OVER (PARTITION BY deck ORDER BY run) AS prv, lead(transcript_id) OVER (PARTITION BY deck ORDER BY run) AS nx FROM r),
target AS (SELECT deck, run, score AS mean, transcript_id AS old, CASE
    WHEN n_pages >= 3 THEN transcript_id
    WHEN transcript_id IS NULL THEN CASE WHEN top_score >= {THRESHOLD} THEN NULL WHEN lft = rgt THEN lft
      WHEN (lft IS NULL) <> (rgt IS NULL) AND score > 0 THEN coalesce(lft, rgt) END
    WHEN prv IS NOT NULL AND nx IS NOT NULL THEN CASE WHEN prv = nx THEN prv END
    ELSE transcript_id END AS target FROM near),
smoothed AS (SELECT p.deck, p.page_no, t.target AS transcript_id,
    CASE WHEN t.target IS DISTINCT FROM t.old THEN t.mean ELSE p.score END AS score FROM r_pages p JOIN target t USING (deck, run))"""
SMOOTH = f"{BEST},\n{SMOOTHED}"
RANGES = f"{SMOOTH},\n{runs_sql('smoothed', 's')}"


def scores(v):
    return m.nearest_lecture_join(v["page_vectors"], v["course_lecture_vectors"])


def best(v):
    return m.best_page_match(m.top_lectures(v["page_vectors"], v["course_lecture_vectors"], 2), v["page_vectors"], THRESHOLD, MARGIN)


@query("nearest_lecture_join", f"WITH {SCORES} SELECT project_id, deck, page_no, transcript_id, round(score, 6) AS score FROM scores")
def _(v):
    from pyspark.sql import functions as F

    return scores(v).withColumn("score", F.round("score", 6))


@query("vector_topk", f"""WITH {SCORES} SELECT project_id, deck, page_no, transcript_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, deck, page_no ORDER BY score DESC, transcript_id) AS rank FROM scores) WHERE rank <= 3""")
def _(v):
    from pyspark.sql import functions as F

    return m.top_lectures(v["page_vectors"], v["course_lecture_vectors"], 3).withColumn("score", F.round("score", 6))


@query("best_page_match", f"WITH {BEST} SELECT deck, page_no, transcript_id, score FROM best")
def _(v):
    return best(v)


@query("runs", f"WITH {BEST}, {runs_sql('best', 'r')} SELECT deck, run, page_from, page_to, transcript_id, score, n_pages, top_score FROM r")
def _(v):
    return m.runs(best(v))


@query("smooth_runs", f"WITH {SMOOTH} SELECT deck, page_no, transcript_id, score FROM smoothed")
def _(v):
    return m.smooth_runs(best(v), 3, THRESHOLD)


@query("page_ranges", f"WITH {BEST}, {runs_sql('best', 'r')} SELECT deck, page_from, page_to, transcript_id, score FROM r WHERE transcript_id IS NOT NULL")
def _(v):
    return m.page_ranges(best(v))


#: Deck 4 is an exam; every seventh vector is of an older text; each deck has a confirmed and an automatic link.
DECKS = "SELECT DISTINCT deck, CASE WHEN deck % 5 = 4 THEN 'exam' ELSE 'slides' END AS kind FROM page_vectors"
LINKS = """SELECT deck, page_from, page_to, transcript_id, score, link_source FROM (SELECT DISTINCT deck FROM page_vectors)
CROSS JOIN (VALUES (CAST(1 AS BIGINT), CAST(3 AS BIGINT), CAST(0 AS BIGINT), CAST(0.5 AS DOUBLE), 'manual'), (4, 6, 1, 0.6, 'auto')) AS t(page_from, page_to, transcript_id, score, link_source)"""
STALE = "doc_id % 7 = 0 AND length(text) >= 40"


@query("match_pages", f"""WITH decks AS ({DECKS}), links AS ({LINKS}),
mine AS (SELECT * FROM page_vectors WHERE deck IN (SELECT deck FROM decks WHERE kind = 'slides')),
stale AS (SELECT doc_id AS vec_id FROM documents WHERE {STALE}),
known AS (SELECT * FROM mine WHERE vec_id NOT IN (SELECT vec_id FROM stale)),
{BEST.replace("page_vectors", "known").replace("best AS", "found AS")},
best AS (SELECT * FROM found UNION ALL SELECT deck, page_no, NULL, 0.0 FROM mine WHERE vec_id IN (SELECT vec_id FROM stale)),
{SMOOTHED}, {runs_sql("smoothed", "s")},
fresh AS (SELECT deck, page_from, page_to, transcript_id, score, 'auto' AS link_source FROM s WHERE transcript_id IS NOT NULL)
SELECT * FROM links WHERE link_source = 'manual' OR deck IN (SELECT deck FROM decks WHERE kind = 'exam')
UNION ALL SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM links l WHERE link_source = 'manual' AND l.deck = f.deck AND l.page_from = f.page_from AND l.page_to = f.page_to)""")
def _(v):
    spark, pages = v.spark, v["page_vectors"]
    sha = "substring(sha2(case when %s then concat('old ', text) else text end, 256), 1, 16) as source_sha"
    stored = v["documents"].selectExpr("doc_id as ref_id", sha % STALE)
    given = pages.withColumnRenamed("vec_id", "ref_id").join(stored, "ref_id", "left")
    decks, links = spark.sql(DECKS.replace("page_vectors", "{p}"), p=pages), spark.sql(LINKS.replace("page_vectors", "{p}"), p=pages)
    return m.match_project(given, v["course_lecture_vectors"], v["documents"].selectExpr("doc_id as ref_id", "text"), decks, links, THRESHOLD, MARGIN)
