"""Queries of corpus cleanup and timed text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import cleanup as op
from ..operators import timed
from ..registry import query
from .retrieval import FMT

KEY = r"CASE WHEN regexp_matches(k, '^[\d\s/|.:-]+$') THEN '#' ELSE k END"
LINES = rf"""raw AS (SELECT deck, page_no, CAST(unnest(range(0, len(l))) AS INTEGER) AS pos, unnest(l) AS line
  FROM (SELECT deck, page_no, string_split(coalesce(text, ''), chr(10)) AS l FROM slide_pages)),
lines AS (SELECT deck, page_no, pos, line, {KEY} AS key FROM (SELECT *, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS k FROM raw)),
common AS (SELECT deck, key, count(DISTINCT page_no) AS n FROM lines JOIN (SELECT deck, count(*) AS n_pages FROM slide_pages GROUP BY 1) USING (deck) WHERE key <> ''
  GROUP BY deck, key, n_pages HAVING count(DISTINCT page_no) > 0.05 * n_pages AND n_pages >= 3 AND (length(key) > 1 OR key = '#'))"""
STRIPPED = f"""{LINES}, stripped AS (SELECT p.deck, p.page_no, coalesce(s.text, '') AS text FROM slide_pages p LEFT JOIN
  (SELECT deck, page_no, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines WHERE NOT EXISTS (SELECT 1 FROM common c WHERE c.deck = lines.deck
  AND c.key = lines.key) GROUP BY ALL) s USING (deck, page_no))"""


def review_sql(text: str, images: str) -> str:
    full = f"list_filter(string_split({text}, chr(10)), lambda x: trim(x) <> '')"
    short = rf"list_filter({full}, lambda x: len(regexp_split_to_array(trim(x), '\s+')) <= 2)"
    return f"(trim({text}) = '' OR regexp_matches({text}, '{op.MATH}') OR (len({full}) >= 6 AND 2 * len({short}) > len({full})) OR ({images} > 0 AND length({text}) < 300))"


@query("boilerplate_lines", f"WITH {LINES} SELECT * FROM common")
def _(v):
    return op.boilerplate_keys(v["slide_pages"], 0.05)


@query("strip_boilerplate", f"WITH {STRIPPED} SELECT * FROM stripped")
def _(v):
    return op.strip_boilerplate(v["slide_pages"], 0.05)


def flagged(pages):
    return pages.select("*", op.page_needs_review(F.col("text"), F.lit(False), (F.col("page_no") % 7 == 0).cast("int")).alias("needs"))


@query("page_needs_review", f"SELECT deck, page_no, {review_sql('text', '(CASE WHEN page_no % 7 = 0 THEN 1 ELSE 0 END)')} AS needs FROM slide_pages")
def _(v):
    return flagged(v["slide_pages"]).select("deck", "page_no", "needs")


@query("review_queue", f"SELECT deck, page_no FROM slide_pages WHERE page_no <= 40 AND page_no % 5 <> 0 AND {review_sql('text', '(CASE WHEN page_no % 7 = 0 THEN 1 ELSE 0 END)')}")
def _(v):
    return op.review_queue(flagged(v["slide_pages"]).withColumn("rendered", F.col("page_no") % 5 == 0), cap=40)


@query("clean_corpus", f"WITH {STRIPPED} SELECT deck, page_no FROM stripped WHERE page_no <= 80 AND {review_sql('text', '(CASE WHEN page_no % 7 = 0 THEN 1 ELSE 0 END)')}")
def _(v):
    # what is boilerplate follows from all pages of a deck; only the first 80 can be in the queue
    common = op.boilerplate_keys(v["slide_pages"], 0.05)
    stripped = op.strip_boilerplate(v["slide_pages"].where("page_no <= 80"), common=common)
    return op.review_queue(flagged(stripped).withColumn("rendered", F.lit(False)), cap=80)


@query("math_uncertain", f"SELECT doc_id, upper(text) LIKE '%UNCERTAIN%' OR (regexp_matches(source || ' √', '{op.MATH}') AND NOT contains(text, '$')) AS uncertain FROM documents")
def _(v):
    return v["documents"].select("doc_id", op.math_uncertain(F.col("text"), F.concat("source", F.lit(" √"))).alias("uncertain"))


@query("clip_flag", "SELECT page_id, bool_or(x0 < 900 * 0.02::DOUBLE OR x1 > 900 * 0.98::DOUBLE) AS clipped FROM boxes GROUP BY 1")
def _(v):
    return op.clip_flag(v["boxes"], 900.0)


@query("reading_order", """WITH b AS (SELECT page_id, greatest(4.0::DOUBLE, 0.6::DOUBLE * list_sort(list(CAST(y1 - y0 AS DOUBLE)))[len(list(y1)) // 2 + 1]) AS band FROM boxes GROUP BY 1)
SELECT page_id, box_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY round_even((y0 + y1) / 2 / band, 0), x0, box_id, text, y1) AS INTEGER) AS place, text
  FROM boxes JOIN b USING (page_id)""")
def _(v):
    return op.reading_order(v["boxes"])


@query("course_vocabulary", rf"""WITH s AS (SELECT project_id, doc_id, text FROM slide_pages WHERE kind = 'slides'),
f AS (SELECT DISTINCT project_id, doc_id, unnest(list_concat(list_filter(regexp_extract_all(text, '{op.HYPHENATED}'), lambda x: contains(x, '-')),
  regexp_extract_all(text, '{op.PIECE}'))) AS term FROM s),
df AS (SELECT project_id, term, count(*) AS df FROM f WHERE regexp_matches(term, '{op.TERM}') GROUP BY ALL HAVING count(*) >= 2 AND length(term) <= 30 AND NOT regexp_matches(term, '{op.ROMAN}')),
low AS (SELECT DISTINCT project_id, unnest(regexp_extract_all(text, '{t.TOKEN}')) AS common FROM s),
top AS (SELECT project_id, 1 AS tier, row_number() OVER (PARTITION BY project_id ORDER BY df DESC, term) AS place, term FROM df
  WHERE NOT (term = upper(term) AND EXISTS (SELECT 1 FROM low WHERE low.project_id = df.project_id AND common = lower(term)))),
a AS (SELECT * FROM top WHERE place <= 30 UNION ALL SELECT p.project_id, 0, id, repl FROM terms, (SELECT DISTINCT project_id FROM s) p WHERE auto = 1),
d AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY project_id, lower(term) ORDER BY tier, place) = 1),
r AS (SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY tier, place, term) AS INTEGER) AS rank, term FROM d) SELECT * FROM r WHERE rank <= 40""")
def _(v):
    courses = v["slide_pages"].where("kind = 'slides'").select("project_id").distinct()
    return op.course_vocabulary(v["slide_pages"], courses.crossJoin(F.broadcast(v["terms"])))  # six fixed terms


@query("distinct_terms", """SELECT CAST(row_number() OVER (ORDER BY first, lower_term) AS INTEGER) AS rank, first_term AS term, 0 AS project_id
  FROM (SELECT lower(p_name) AS lower_term, arg_min(p_name, p_partkey) AS first_term, min(p_partkey) AS first FROM part GROUP BY 1) QUALIFY rank <= 25""")
def _(v):
    return op.distinct_terms(v["part"].selectExpr("0 as project_id", "0 as tier", "p_partkey as place", "p_name as term"), 25)


RAW = f"SELECT transcript_id, string_agg(CASE WHEN idx % 3 = 2 THEN text ELSE concat('[', {FMT}, '] ', text) END, chr(10) ORDER BY idx) AS value FROM segments GROUP BY 1"


def raw_files(v):
    line = F.when(F.col("idx") % 3 == 2, F.col("text")).otherwise(F.concat(F.lit("["), t.fmt_ts(F.col("start_s")), F.lit("] "), "text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "\n")
    return v["segments"].groupBy("transcript_id").agg(joined.alias("value")).select(F.col("transcript_id").cast("string").alias("path"), "value")


STAMPED = r"""raw AS (%s), l AS (SELECT CAST(transcript_id AS VARCHAR) AS path, unnest(range(0, len(x))) AS pos, unnest(x) AS line
  FROM (SELECT transcript_id, string_split(value, chr(10)) AS x FROM raw)),
s AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*\[(?:\d+:)?\d{1,2}:\d{2}\]') THEN 3600 * coalesce(TRY_CAST(regexp_extract(line, '^\s*\[(\d+):\d{1,2}:\d{2}\]', 1) AS DOUBLE), 0)
  + 60 * CAST(regexp_extract(line, '(\d{1,2}):\d{2}\]', 1) AS DOUBLE) + CAST(regexp_extract(line, ':(\d{2})\]', 1) AS DOUBLE) END AS at_s FROM l WHERE trim(line) <> '')""" % RAW
SCANNED = STAMPED + r""", g AS (SELECT *, sum(CASE WHEN at_s IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS island FROM s),
b AS (SELECT path, island, max(at_s) AS start, trim(string_agg(trim(regexp_replace(line, '^\s*\[[0-9:]+\]\s*', '')), chr(10) ORDER BY pos)) AS text FROM g GROUP BY ALL),
scanned AS (SELECT path, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, start, coalesce(lead(start) OVER w, start) AS "end", text, true AS ts,
  CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY path ORDER BY island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM b
  WINDOW w AS (PARTITION BY path ORDER BY island))"""


@query("scan_timed_text", f"WITH {SCANNED} SELECT * FROM scanned")
def _(v):
    return timed.scan_timed_text(raw_files(v))


@query("resume_point", f"WITH {STAMPED} SELECT path, greatest(arg_max(at_s, pos) - 2, 0) AS resume_s FROM s WHERE at_s IS NOT NULL GROUP BY 1")
def _(v):
    return timed.resume_point(raw_files(v).select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line")))


@query("resume_filter", "SELECT transcript_id, idx, end_s FROM segments WHERE end_s > 200")
def _(v):
    return timed.resume_filter(v["segments"], 200.0).select("transcript_id", "idx", "end_s")


@query("segment_offsets", "SELECT transcript_id, idx, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY transcript_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM segments")
def _(v):
    return timed.segment_offsets(v["segments"], "transcript_id", "idx").select("transcript_id", "idx", "offset")


BUCKETS = """buckets AS (SELECT transcript_id, idx, text, bucket, lag(bucket) OVER (PARTITION BY transcript_id ORDER BY idx) IS DISTINCT FROM bucket AS heading
  FROM (SELECT *, CAST(floor(start_s / 300) AS BIGINT) AS bucket FROM segments))"""


@query("time_buckets", f"WITH {BUCKETS} SELECT transcript_id, idx, bucket, heading FROM buckets")
def _(v):
    return timed.time_buckets(v["segments"]).select("transcript_id", "idx", "bucket", "heading")


MARKDOWN = f"""{BUCKETS}, x AS (SELECT *, bucket * 300.0 AS start_s FROM buckets),
md AS (SELECT transcript_id, concat('# Lecture ', transcript_id, chr(10), string_agg(concat(CASE WHEN heading THEN concat('## ', {FMT}, chr(10)) ELSE '' END, text), chr(10) ORDER BY idx)) AS markdown
  FROM x GROUP BY 1)"""


@query("segments_to_markdown", f"WITH {MARKDOWN} SELECT * FROM md")
def _(v):
    return timed.segments_to_markdown(v["segments"])


RETIMED = """x AS (SELECT s.transcript_id, s.idx, s.text, CASE WHEN s.transcript_id % 3 <> 1 AND s.idx % 5 = 3 THEN s.start_s * 1.5::DOUBLE END AS at_s, CASE
  WHEN s.transcript_id % 3 = 0 AND s.idx % 4 <> 2 THEN s.start_s END AS old FROM segments s),
dur AS (SELECT transcript_id, max(CASE WHEN transcript_id % 3 = 0 THEN end_s END) AS duration FROM segments GROUP BY 1),
r AS (SELECT transcript_id, idx, text, at_s IS NOT NULL AS ts, coalesce(at_s, old) AS raw, coalesce(duration, 0) AS duration FROM x LEFT JOIN dur USING (transcript_id)),
n AS (SELECT *, max(raw) OVER b AS from_s, max(CASE WHEN raw IS NOT NULL THEN idx END) OVER b AS from_i, min(CASE WHEN raw IS NOT NULL THEN idx END) OVER f AS to_i,
  count(*) OVER (PARTITION BY transcript_id) AS n, count(raw) OVER (PARTITION BY transcript_id) AS known FROM r
  WINDOW b AS (PARTITION BY transcript_id ORDER BY idx ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY transcript_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
m AS (SELECT n.*, coalesce(t.raw, n.duration) AS to_s, coalesce(n.to_i, n.n) AS to_p FROM n LEFT JOIN r t ON t.transcript_id = n.transcript_id AND t.idx = n.to_i),
s0 AS (SELECT *, CASE WHEN known = 0 THEN CASE WHEN duration > 0 THEN duration * idx / n ELSE idx END WHEN raw IS NOT NULL THEN from_s WHEN from_i IS NULL THEN 0
  ELSE from_s + (to_s - from_s) / (to_p - from_i) * (idx - from_i) END AS s FROM m),
s1 AS (SELECT *, max(s) OVER (PARTITION BY transcript_id ORDER BY idx) AS start_s FROM s0),
retimed AS (SELECT transcript_id, idx, start_s, coalesce(lead(start_s) OVER (PARTITION BY transcript_id ORDER BY idx), greatest(duration, start_s)) AS end_s, text, ts,
  CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY transcript_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM s1)"""


@query("retime_segments", f'WITH {RETIMED} SELECT transcript_id, idx, round(start_s, 4) AS start_s, round(end_s, 4) AS end_s, text, ts, "offset" FROM retimed')
def _(v):
    # a third of the lectures had times before, of most of their segments; the rest had none
    lines = v["segments"].selectExpr("transcript_id", "idx", "text", "case when transcript_id % 3 <> 1 and idx % 5 = 3 then start_s * 1.5D end as at")
    start, end = "case when transcript_id % 3 = 0 and idx % 4 <> 2 then start_s end as start_s", "case when transcript_id % 3 = 0 then end_s end as end_s"
    out = timed.retime_segments(lines, v["segments"].selectExpr("transcript_id", "idx", start, end))
    return out.withColumn("start_s", F.round("start_s", 4)).withColumn("end_s", F.round("end_s", 4))


@query("scan_paged_text", """WITH RECURSIVE b AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS bs FROM documents),
f AS (SELECT doc_id, bs, 1 AS i, 1 AS page_no, bs[1] AS text FROM b WHERE len(bs) > 0
  UNION ALL SELECT doc_id, bs, i + 1, CASE WHEN length(text) + length(bs[i + 1]) > 1500 THEN page_no + 1 ELSE page_no END,
    CASE WHEN length(text) + length(bs[i + 1]) > 1500 THEN bs[i + 1] ELSE text || chr(10) || bs[i + 1] END FROM f WHERE i < len(bs))
SELECT doc_id, page_no, arg_max(text, i) AS text FROM f GROUP BY ALL""")
def _(v):
    return timed.scan_paged_text(v["documents"], 1500, "\n")
