"""Queries of listings and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as j
from ..operators import listings as op
from ..registry import query

CARDS = "SELECT run_id * 100 + pos AS id, run_id AS transcript_id, CASE WHEN pos % 4 = 3 THEN 'suspended' ELSE 'active' END AS status FROM card_items"
COURSES = "SELECT n_nationkey AS project_id, n_name AS course_name FROM nation"
SHORT = r"coalesce(nullif(regexp_extract(title, '^.+?\s+[–—]\s+(.+)$', 1), ''), title)"
RATED = "rated AS (SELECT project_id, transcript_id, CASE WHEN duration / 60 >= 10 THEN CAST(round_even(chars / (duration / 60), 0) AS BIGINT) END AS chars_per_min FROM lectures)"
LOW = f"""{RATED},
vals AS (SELECT project_id, chars_per_min, row_number() OVER (PARTITION BY project_id ORDER BY chars_per_min, transcript_id) AS rn, count(*)
  OVER (PARTITION BY project_id) AS n FROM rated WHERE chars_per_min > 0),
med AS (SELECT project_id, chars_per_min AS median FROM vals WHERE rn = n // 2 + 1 AND n >= 3),
low AS (SELECT r.project_id, transcript_id, chars_per_min, median, coalesce(chars_per_min > 0 AND chars_per_min < 0.55 * median, false) AS low_coverage FROM rated r
  LEFT JOIN med USING (project_id))"""
NUMBERS = "numbers AS (SELECT project_id, transcript_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at, transcript_id) AS INTEGER) AS lecture_no FROM lectures)"
#: Lectures that have a summary, with the newest; the given tables hold titles, so these stand for the notes too.
SUMMARISED = f"""{NUMBERS}, newest AS (SELECT transcript_id, arg_max(title, (id, title)) AS title FROM summaries GROUP BY 1),
summarised AS (SELECT project_id, transcript_id, lecture_no, concat('L', lecture_no) AS label, title FROM numbers JOIN newest USING (transcript_id)),
notes AS (SELECT project_id, string_agg(concat('<lecture id="', label, '" title="', title, '">', chr(10), substr(title, 1, 9000), chr(10), '</lecture>'),
  chr(10) || chr(10) ORDER BY lecture_no) AS notes,
  count(*) AS n_lectures FROM summarised GROUP BY 1)"""
INT = lambda x: f"CAST({x} AS BIGINT)"


def cards(v):
    return v["card_items"].selectExpr("run_id * 100 + pos as id", "run_id as transcript_id", "case when pos % 4 = 3 then 'suspended' else 'active' end as status")


def courses(v):
    return v["nation"].selectExpr("n_nationkey as project_id", "n_name as course_name")


@query("light_listing", "SELECT doc_id, source, lang, length(text) AS n_text FROM documents")
def _(v):
    return v["documents"].select("doc_id", "source", "lang", F.length("text").cast("long").alias("n_text"))


@query("usable_filters", "SELECT id, project_id, kind, status FROM jobs WHERE project_id = 3 AND status IN ('running', 'failed') AND kind = 'llm_cards' ORDER BY id DESC LIMIT 100")
def _(v):
    return usable_filters(v["jobs"], project=3, statuses=["running", "failed"], kind="llm_cards").orderBy(F.desc("id")).limit(100).select("id", "project_id", "kind", "status")


def usable_filters(df, project=None, statuses=None, kind=None):
    """The optional filters of a listing; those that are not given do nothing."""
    for column, values in (("project_id", None if project is None else [project]), ("status", statuses), ("kind", None if kind is None else [kind])):
        if values is not None:
            df = df.where(F.col(column).isin(values))
    return df


@query("scan_entities", "SELECT project_id, count(*) AS n FROM jobs WHERE status = 'done' AND tokens_in >= 100 GROUP BY project_id")
def _(v):
    sql = "select project_id, count(*) as n from {jobs} where status = :status and tokens_in >= :least group by project_id"
    return v.spark.sql(sql, args={"status": "done", "least": 100}, jobs=v["jobs"])


@query("latest_per_key", "SELECT transcript_id, id, created_at, title FROM summaries QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY created_at DESC, id DESC) = 1")
def _(v):
    return op.latest_per_key(v["summaries"].select("transcript_id", "id", "created_at", "title"), ["transcript_id"], ["created_at", "id"])


@query("display_title", f"""WITH s AS (SELECT transcript_id, title FROM summaries WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY created_at DESC, id DESC) = 1)
SELECT l.transcript_id, coalesce({SHORT}, concat('Lecture ', CAST(l.transcript_id AS VARCHAR))) AS display_title FROM lectures l LEFT JOIN s USING (transcript_id)""")
def _(v):
    return op.display_title(v["lectures"], v["summaries"])


@query("lecture_numbers", f"WITH {NUMBERS} SELECT *, concat('L', CAST(lecture_no AS VARCHAR)) AS label FROM numbers")
def _(v):
    return op.lecture_numbers(v["lectures"])


@query("low_coverage", f"WITH {LOW} SELECT * FROM low")
def _(v):
    return op.low_coverage(v["lectures"])


@query("card_counts", f"""SELECT transcript_id, count(*) AS n_cards, count(*) FILTER (status = 'active') AS n_active,
  count(*) FILTER (status = 'suspended') AS n_suspended FROM ({CARDS}) GROUP BY transcript_id""")
def _(v):
    return op.card_counts(cards(v))


LISTING = f"""{LOW}, {NUMBERS},
s AS (SELECT transcript_id, count(*) AS n_summaries, arg_max(id, (created_at, id)) AS summary_id, arg_max(title, (created_at, id, title)) AS summary_title FROM summaries GROUP BY transcript_id),
c AS (SELECT transcript_id, count(*) AS n_cards FROM ({CARDS}) GROUP BY transcript_id),
k AS (SELECT transcript_id, count(*) AS n_links FROM slide_links GROUP BY transcript_id),
listing AS (SELECT l.project_id, l.transcript_id, CAST(l.chars AS BIGINT) AS chars, lecture_no, coalesce(n_summaries, 0) AS n_summaries, summary_id, summary_title,
  coalesce(n_cards, 0) AS n_cards, coalesce(n_links, 0) AS n_links, chars_per_min, low_coverage
FROM lectures l LEFT JOIN numbers USING (transcript_id) LEFT JOIN s USING (transcript_id) LEFT JOIN c USING (transcript_id) LEFT JOIN k USING (transcript_id) LEFT JOIN low USING (transcript_id))"""


def listing(v):
    return op.lecture_listing(v["lectures"], v["summaries"], cards(v), v["slide_links"])


@query("lecture_listing", f"WITH {LISTING} SELECT * FROM listing")
def _(v):
    return listing(v)


@query("lecture_detail", f"""WITH {LISTING} SELECT g.*, course_name, coalesce({SHORT.replace('title', 'summary_title')}, 'untitled') AS display_title FROM listing g
  LEFT JOIN ({COURSES}) USING (project_id)""")
def _(v):
    return listing(v).join(courses(v), "project_id", "left").withColumn("display_title", F.coalesce(op.short_title(F.col("summary_title")), F.lit("untitled")))


@query("course_report", f"""WITH {LISTING} SELECT project_id, count(*) AS n_lectures, count(*) FILTER (low_coverage) AS n_low, {INT('sum(n_summaries)')} AS n_summaries,
  count(*) FILTER (study_status IN ('reviewed', 'confident')) AS n_done FROM listing LEFT JOIN study USING (transcript_id) GROUP BY project_id""")
def _(v):
    done = F.count_if(F.col("study_status").isin("reviewed", "confident"))
    rows = listing(v).join(v["study"], "transcript_id", "left").groupBy("project_id")
    return rows.agg(F.count(F.lit(1)).alias("n_lectures"), F.count_if("low_coverage").alias("n_low"), F.sum("n_summaries").alias("n_summaries"), done.alias("n_done"))


@query("course_listing", f"""SELECT c.*, coalesce(l.n, 0) AS n_lectures, coalesce(o.n, 0) AS n_ok_sources FROM ({COURSES}) c
LEFT JOIN (SELECT project_id, count(*) AS n FROM lectures GROUP BY 1) l USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n FROM jobs WHERE kind = 'transcribe' AND status = 'done' GROUP BY 1) o USING (project_id)""")
def _(v):
    return op.course_listing(courses(v), v["lectures"], v["jobs"])


@query("deck_listing", """SELECT deck, count(*) AS n_pages, count(*) FILTER (length(text) < 300) AS n_short, coalesce(any_value(n), 0) AS n_links
FROM slide_pages LEFT JOIN (SELECT deck, count(*) AS n FROM slide_links GROUP BY 1) USING (deck) GROUP BY deck""")
def _(v):
    return op.deck_listing(v["slide_pages"], v["slide_links"])


@query("job_listing", f"""SELECT j.*, course_name, lecture_title FROM jobs j LEFT JOIN ({COURSES}) USING (project_id)
LEFT JOIN (SELECT transcript_id, arg_max(title, (id, title)) AS lecture_title FROM summaries WHERE title <> '' GROUP BY 1) USING (transcript_id)""")
def _(v):
    return op.job_listing(v["jobs"], courses(v), v["summaries"])


@query("job_board", """WITH last AS (SELECT coalesce('t' || CAST(transcript_id AS VARCHAR), 'j' || CAST(id AS VARCHAR)) AS key, kind, max(id) AS id, arg_max(status,
  id) AS status FROM jobs GROUP BY 1, 2),
r AS (SELECT *, CASE status WHEN 'running' THEN 4 WHEN 'queued' THEN 3 WHEN 'failed' THEN 2 WHEN 'interrupted' THEN 2 ELSE 1 END AS rank FROM last)
SELECT key, arg_max(status, (rank, id)) AS status, count(*) AS n_steps, count(*) FILTER (status = 'done') AS n_done, max(id) AS last_id FROM r GROUP BY key""")
def _(v):
    return op.job_board(v["jobs"])


@query("failed_since", "SELECT project_id, count(*) AS n FROM jobs WHERE status = 'failed' AND finished_at > TIMESTAMP '1996-01-01' GROUP BY project_id")
def _(v):
    return v["jobs"].where("status = 'failed' and finished_at > timestamp_ntz '1996-01-01'").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query("queue_eta", """WITH sp AS (SELECT project_id, avg(CAST(tokens_in AS DOUBLE) / 100) AS speed FROM (SELECT * FROM jobs WHERE status = 'done' AND kind = 'transcribe' AND tokens_in > 0
  QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY id DESC) <= 10) GROUP BY 1),
s AS (SELECT project_id, CASE WHEN tokens_in % 2 = 0 THEN tokens_in / 100.0 ELSE 40 END AS s FROM jobs WHERE status = 'running' AND kind <> 'transcribe'
UNION ALL SELECT project_id, CASE WHEN kind = 'transcribe' THEN CAST(cost_micro AS DOUBLE) / 10 / coalesce(speed, 10) + 20 WHEN kind LIKE 'llm%' THEN 40 ELSE 15 END
  FROM jobs LEFT JOIN sp USING (project_id) WHERE status = 'failed')
SELECT project_id, round(sum(s), 2) AS eta_s FROM s GROUP BY project_id""")
def _(v):
    jobs = v["jobs"]
    running = jobs.where("status = 'running' and kind <> 'transcribe'").selectExpr("project_id", "case when tokens_in % 2 = 0 then tokens_in / 100D end as eta")
    queued = jobs.where("status = 'failed'").selectExpr("project_id", "kind", "cast(cost_micro as double) / 10 as duration")
    done = jobs.where("status = 'done' and kind = 'transcribe'").selectExpr("project_id", "id", "cast(tokens_in as double) / 100 as speed")
    return op.queue_eta(running, queued, done).select("project_id", F.round("eta_s", 2).alias("eta_s"))


@query("throughput_report", """SELECT project_id, CAST(sum(tokens_in) AS DOUBLE) AS audio_s, CAST(sum(cost_micro) AS DOUBLE) AS elapsed_s,
  round(CAST(sum(tokens_in) AS DOUBLE) / CAST(sum(cost_micro) AS DOUBLE), 4) AS x_realtime, count(*) FILTER (status <> 'failed') AS n_ok, count(*) FILTER (status = 'failed') AS n_error
FROM jobs WHERE kind = 'transcribe' GROUP BY project_id""")
def _(v):
    rows = v["jobs"].where("kind = 'transcribe'").selectExpr("project_id", "cast(tokens_in as double) as audio_s", "cast(cost_micro as double) as elapsed_s", "case when status = 'failed' then 'x' end as error")
    return op.throughput_report(rows)


@query("study_progress", """SELECT project_id, count(*) FILTER (study_status IN ('reviewed', 'confident')) AS n_done, count(*) AS n_lectures, round(sum(duration), 3) AS duration
FROM lectures LEFT JOIN study USING (transcript_id) GROUP BY project_id""")
def _(v):
    return op.study_progress(v["lectures"], v["study"])


@query("dominant_language", """WITH n AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL)
SELECT source, arg_min(lang, (-n, lang)) AS language FROM n GROUP BY source""")
def _(v):
    return op.dominant_language(v["documents"], "source")


@query("previous_lectures", """WITH s AS (SELECT l.transcript_id, s.title AS prev_title, s.id AS summary_id, row_number() OVER (PARTITION BY l.transcript_id
  ORDER BY s.created_at DESC, s.id DESC) AS rank
  FROM lectures l JOIN lectures o ON l.project_id = o.project_id AND l.transcript_id <> o.transcript_id JOIN summaries s ON s.transcript_id = o.transcript_id)
SELECT transcript_id, prev_title, CAST(rank AS INTEGER) AS rank, summary_id FROM s WHERE rank <= 5""")
def _(v):
    return op.previous_lectures(v["lectures"], v["summaries"])


LINKED = """linked AS (SELECT k.*, p.page_no, p.text, p.kind, row_number() OVER (PARTITION BY k.transcript_id ORDER BY link_source <> 'manual', score DESC, k.deck, page_from, p.page_no, id) AS rank
  FROM slide_links k JOIN slide_pages p ON k.deck = p.deck AND p.page_no BETWEEN page_from AND page_to)"""


def linked(v):
    return j.link_pages_join(v["slide_links"], v["slide_pages"])


@query("link_pages_join", f"WITH {LINKED} SELECT transcript_id, deck, page_no, text, score, link_source, CAST(rank AS INTEGER) AS rank FROM linked")
def _(v):
    return linked(v).select("transcript_id", "deck", "page_no", "text", "score", "link_source", "rank")


@query("manual_over_auto", f"""WITH {LINKED}, m AS (SELECT *, bool_or(link_source = 'manual')
  OVER (PARTITION BY transcript_id) AS has, count(*) FILTER (link_source <> 'manual') OVER (PARTITION BY transcript_id) AS n FROM linked)
SELECT transcript_id, deck, page_no, link_source, CASE WHEN has THEN n ELSE 0 END AS n_ignored FROM m WHERE link_source = 'manual' OR NOT has""")
def _(v):
    return j.manual_over_auto(linked(v)).select("transcript_id", "deck", "page_no", "link_source", "n_ignored")


@query("budget_prefix", f"""WITH {LINKED}, u AS (SELECT transcript_id, deck, page_no, sum(length(text)) OVER (PARTITION BY transcript_id ORDER BY rank) AS used FROM linked)
SELECT transcript_id, deck, page_no, CAST(used AS BIGINT) AS used FROM u WHERE used <= 6000""")
def _(v):
    blocks = linked(v).withColumn("len", F.length("text").cast("long"))
    return j.budget_prefix(blocks, "transcript_id", ["rank"], 6000).select("transcript_id", "deck", "page_no", "used")


@query("link_listing", """SELECT k.id, k.deck, k.page_from, k.page_to, k.transcript_id, t.title, p.text AS first_text FROM slide_links k JOIN lectures USING (transcript_id)
JOIN (SELECT transcript_id, arg_max(title, (id, title)) AS title FROM summaries GROUP BY 1) t USING (transcript_id) LEFT JOIN slide_pages p ON p.deck = k.deck AND p.page_no = k.page_from""")
def _(v):
    titles = v["summaries"].groupBy("transcript_id").agg(F.max_by("title", F.struct("id", "title")).alias("title"))
    return j.link_listing(v["slide_links"], v["slide_pages"], v["lectures"], titles).select("id", "deck", "page_from", "page_to", "transcript_id", "title", "first_text")


@query("lectures_with_latest_summary", f"""WITH {NUMBERS} SELECT project_id, transcript_id, summary_id, title, concat('L', CAST(lecture_no AS VARCHAR)) AS label
FROM numbers JOIN (SELECT transcript_id, max(id) AS summary_id, arg_max(title, (id, title)) AS title FROM summaries GROUP BY 1) USING (transcript_id)""")
def _(v):
    return j.lectures_with_latest_summary(v["lectures"], v["summaries"], op.lecture_numbers(v["lectures"]))


@query("exam_pages", "SELECT project_id, deck, page_no, text FROM slide_pages WHERE kind = 'exam'")
def _(v):
    return j.exam_pages(v["slide_pages"]).select("project_id", "deck", "page_no", "text")


@query("stale_vectors", """WITH h AS (SELECT doc_id AS ref_id, text, substr(sha256(text), 1, 16) AS source_sha FROM documents WHERE length(text) >= 40)
SELECT ref_id, source_sha FROM h WHERE NOT (ref_id % 3 = 0 OR (ref_id % 3 = 1 AND false))""")
def _(v):
    texts = v["documents"].selectExpr("doc_id as ref_id", "text")
    stored = texts.where("ref_id % 3 <> 2").selectExpr("ref_id", "substring(sha2(if(ref_id % 3 = 1, concat(text, ' old'), text), 256), 1, 16) as source_sha")
    return j.stale_vectors(texts, stored).select("ref_id", "source_sha")


@query("pending_inputs", "SELECT transcript_id, project_id FROM lectures WHERE transcript_id NOT IN (SELECT transcript_id FROM summaries WHERE transcript_id % 3 = 0)")
def _(v):
    return j.pending_inputs(v["lectures"].select("transcript_id", "project_id"), v["summaries"].where("transcript_id % 3 = 0"), "transcript_id")


@query("duplicate_inputs", """WITH k AS (SELECT source, doc_id, sha256(text) AS sha, CAST(strlen(text) AS INTEGER) AS bytes FROM documents),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY source, sha, bytes) AS duplicate_of FROM k) SELECT * FROM f WHERE doc_id <> duplicate_of""")
def _(v):
    return j.duplicate_inputs(v["documents"].selectExpr("source", "doc_id", "text as content"), "source", "doc_id")


# a running job counts as active in even courses; in the others it is taken to be interrupted
@query("followups_due", """WITH active AS (SELECT DISTINCT project_id FROM jobs WHERE kind = 'llm_fix' AND status = 'running' AND project_id % 2 = 0)
SELECT DISTINCT project_id FROM slide_pages ANTI JOIN active USING (project_id) WHERE kind = 'slides'""")
def _(v):
    status = F.when((F.col("status") == "running") & (F.col("project_id") % 2 == 1), "interrupted").otherwise(F.col("status"))
    return j.followups_due(v["slide_pages"], v["jobs"].withColumn("status", status))


@query("orphans_cascade", """SELECT id, CASE WHEN transcript_id % 4 <> 0 THEN transcript_id END AS transcript_id FROM summaries WHERE job_id IS NULL AND transcript_id IN (SELECT transcript_id FROM lectures WHERE project_id < 7)""")
def _(v):
    kept = j.orphans_cascade(v["summaries"].where("job_id is null"), v["lectures"].where("project_id < 7"), "transcript_id")
    left = v["lectures"].where("transcript_id % 4 <> 0")
    return j.orphans_cascade(kept, left, "transcript_id", set_null=True).select("id", "transcript_id")


def summarised(v):
    numbers = op.lecture_numbers(v["lectures"])
    newest = j.lectures_with_latest_summary(v["lectures"], v["summaries"], numbers).select("transcript_id", "title")
    return numbers.join(newest, "transcript_id").withColumn("markdown", F.col("title"))
