"""The entity tables of a study platform as views over the given parquet tables.

One definition serves both engines; where dialects differ there are two.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()

SHARED = {
    "segments": """SELECT conv_id % 10 AS project_id, conv_id AS transcript_id, turn AS idx, role, text,
  CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS double) / 2.0 AS start_s,
  CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS double) / 2.0 AS end_s
FROM conversations""",
    "lectures": """SELECT project_id, transcript_id, transcript_id AS created_at, count(*) AS n_segments,
  sum(length(text)) + count(*) - 1 AS chars, max(end_s) * (1 + transcript_id % 4) AS duration
FROM segments GROUP BY project_id, transcript_id""",
    "slide_pages": """SELECT CAST(substr(source, 4) AS int) % 10 AS project_id, source AS deck,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no, doc_id, text,
  CASE WHEN CAST(substr(source, 4) AS int) % 5 = 4 THEN 'exam' ELSE 'slides' END AS kind
FROM documents""",
    # one range for every five pages of every deck; one in eleven overlaps the next
    "slide_links": """SELECT id, deck, page_from, CASE WHEN id % 11 = 0 THEN page_to + 2 ELSE page_to END AS page_to,
  id % 100 AS transcript_id, 0.5 + (id % 40) * 0.01 AS score, CASE WHEN id % 3 = 0 THEN 'manual' ELSE 'auto' END AS link_source
FROM (SELECT min(doc_id) AS id, deck, min(page_no) AS page_from, max(page_no) AS page_to
  FROM slide_pages GROUP BY deck, CAST(floor((page_no - 1) / 5) AS bigint)) AS ranges""",
    "jobs": """SELECT o_orderkey AS id, o_custkey % 20 AS project_id, o_orderkey % 400 AS transcript_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'llm_summary' WHEN '2' THEN 'llm_fix' WHEN '3' THEN 'llm_cards'
    WHEN '4' THEN 'transcribe' ELSE 'llm_guide' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS finished_at,
  CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE CAST(floor(o_totalprice / 100) AS bigint) END AS tokens_in,
  CASE WHEN o_orderkey % 14 = 0 THEN 0 ELSE o_orderkey % 900 END AS tokens_out, CASE WHEN o_orderkey % 4 = 1 THEN 64 ELSE 0 END AS cache_hit,
  CAST(floor(o_totalprice) AS bigint) AS cost_micro
FROM orders""",
    "summaries": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 400 AS transcript_id,
  CASE WHEN l_linenumber = 1 THEN l_orderkey END AS job_id, l_shipdate AS created_at,
  CAST(floor(l_quantity) AS bigint) AS tokens_in, l_partkey % 50 AS tokens_out, CASE WHEN l_linenumber = 2 THEN 32 ELSE 0 END AS cache_hit,
  CAST(floor(l_extendedprice) AS bigint) AS cost_micro,
  concat('Course ', CAST(l_orderkey % 20 AS string), ' — Lecture ', CAST(l_partkey AS string)) AS title
FROM lineitem""",
    "questions": """SELECT event_id AS id, user_id % 20 AS project_id, ts AS created_at, CAST(floor(value * 10) AS bigint) AS tokens_in, event_id % 30 AS tokens_out,
  CAST(floor(value * 100) AS bigint) AS cost_micro
FROM events WHERE event_type = 'view'""",
    "progress": """SELECT event_id, ts, user_id AS job_id, event_type AS kind,
  sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS end_s
FROM events""",
    "card_items": """SELECT conv_id AS run_id, conv_id % 10 AS project_id, turn AS pos,
  CASE WHEN turn % 3 = 1 THEN 'cloze' WHEN turn = 6 THEN 'essay' ELSE 'qa' END AS kind,
  CASE WHEN turn = 4 THEN substr(text, 1, 20) WHEN turn % 3 = 1 THEN concat('{{c1::', substr(text, 1, 8), '}} ', substr(text, 9, 20))
    ELSE substr(text, 1, 20) END AS front,
  CASE WHEN turn = 3 THEN '' WHEN turn = 2 THEN concat(role, ' $x_', CAST(conv_id % 3 AS string), ' + 1$') ELSE role END AS back, turn % 2 + 1 AS slide
FROM conversations""",
    "boxes": """SELECT l_orderkey AS page_id, l_linenumber AS box_id, l_returnflag AS text, l_suppkey * 10.0 AS x0,
  l_linenumber * 20.0 + l_partkey % 7 AS y0, l_suppkey * 10.0 + 80 AS x1, l_linenumber * 20.0 + l_partkey % 7 + l_quantity AS y1
FROM lineitem""",
    "study": """SELECT doc_id AS transcript_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'confident' WHEN quality = 1 THEN 'reviewed' ELSE 'todo' END AS study_status
FROM labels""",
    "terms": """SELECT * FROM (VALUES (1, 'the', 'THE', 1), (2, 'and', '&', 1), (3, 'est', 'EST', 1), (4, 'of the', 'OF-THE', 1), (5, 'que', 'que', 1), (6, 'is', 'note only', 0)) AS t(id, find, repl, auto)""",
    "lecture_vectors": """SELECT e.label AS transcript_id, e.embedding AS vec FROM embeddings e
JOIN (SELECT label, min(vec_id) AS v0 FROM embeddings GROUP BY label) m ON e.vec_id = m.v0""",
    "raw_page_vectors": """SELECT e.vec_id % 8 AS deck, row_number() OVER (PARTITION BY e.vec_id % 8 ORDER BY e.label, e.vec_id) AS page_no,
  e.vec_id, e.embedding AS own, r.vec AS base
FROM embeddings e JOIN lecture_vectors r ON e.label = r.transcript_id""",
    # every lecture belongs to both courses, the decks are dealt out between them
    "course_lecture_vectors": "SELECT c.project_id, transcript_id, vec FROM lecture_vectors CROSS JOIN (SELECT 0 AS project_id UNION ALL SELECT 1) AS c",
}
SPARK_VIEWS = SHARED | {
    "page_vectors": """SELECT deck % 2 AS project_id, deck, page_no, vec_id, transform(b, y -> y / sqrt(aggregate(b, 0D, (s, z) -> s + z * z))) AS vec
FROM (SELECT deck, page_no, vec_id, zip_with(base, own, (x, y) -> x + 1.5D * y) AS b FROM raw_page_vectors)""",
}
DUCK_VIEWS = SHARED | {
    "page_vectors": """SELECT deck % 2 AS project_id, deck, page_no, vec_id, list_transform(b, lambda y: y / sqrt(list_sum(list_transform(b, lambda z: z * z)))) AS vec
FROM (SELECT deck, page_no, vec_id, list_transform(list_zip(base, own), lambda x: x[1] + CAST(1.5 AS DOUBLE) * x[2]) AS b FROM raw_page_vectors)""",
}


class Views:
    """``views["segments"]``: a base table or a view over it, loaded when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in BASE_TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                # tables are handed over by value, so a user's own views of these names stay as they are
                sql = SPARK_VIEWS[name].replace("{", "{{").replace("}", "}}")
                used = sorted(o for o in {*BASE_TABLES, *SPARK_VIEWS} - {name} if re.search(rf"\b(FROM|JOIN) {o}\b", sql))
                for other in used:
                    sql = re.sub(rf"\b(FROM|JOIN) {other}\b", rf"\1 {{{other}}}", sql)
                df = self.spark.sql(sql, **{o: self[o] for o in used})
            self._known[name] = df
        return self._known[name]
