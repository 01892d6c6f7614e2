"""Queries of the streaming operators: each reads a given table as a stream and gives what the stream has written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..registry import query
from ..streaming import streams as s
from .matching import MARGIN, RANGES, THRESHOLD
from .retrieval import POSTINGS


def events(v):
    return s.arriving(v.spark, f"{v.sf_dir}/events.parquet")


@query("stream_segments", "SELECT DISTINCT user_id, ts, event_type, value FROM events")
def _(v):
    return s.to_table(s.stream_segments(events(v)).selectExpr("user_id", "cast(ts as timestamp_ntz) as ts", "event_type", "value"), "segments")


@query("stream_progress", """WITH p AS (SELECT user_id AS job_id, round(sum(value), 4) AS position, count(*) AS n_segments, greatest(epoch(max(ts)) - epoch(min(ts)), 0.001::DOUBLE) AS elapsed
  FROM events GROUP BY 1)
SELECT job_id, position, n_segments, round(least(1.0, position / 1000), 4) AS progress, CASE WHEN position > 0 THEN round(position / elapsed, 6) END AS speed,
  CASE WHEN position > 0 AND position < 1000 THEN round((1000.0::DOUBLE - position) / (position / elapsed), 1) END AS eta FROM p""")
def _(v):
    return s.latest(s.stream_progress(events(v), 1000.0), "progress", ["job_id"])


@query("stream_fixed_windows", "SELECT user_id AS job_id, date_trunc('day', ts) AS chunk, count(*) AS n, round(sum(value), 4) AS seconds FROM events GROUP BY ALL")
def _(v):
    return s.latest(s.stream_windows(events(v)), "windows", ["job_id", "chunk"])


@query("stream_job_board", "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n FROM events GROUP BY 1")
def _(v):
    return s.latest(s.stream_job_board(events(v)), "board", ["job_id"])


CHUNKS = """WITH RECURSIVE f AS (SELECT transcript_id, idx, end_s, 0 AS chunk, CAST(0.0 AS DOUBLE) AS last FROM segments WHERE idx = 0
  UNION ALL SELECT s.transcript_id, s.idx, s.end_s, CASE WHEN f.end_s - f.last >= 250 THEN f.chunk + 1 ELSE f.chunk END,
    CASE WHEN f.end_s - f.last >= 250 THEN f.end_s ELSE f.last END FROM f JOIN segments s ON s.transcript_id = f.transcript_id AND s.idx = f.idx + 1)
SELECT transcript_id, idx, chunk FROM f"""


@query("flush_chunks", CHUNKS)
def _(v):
    return s.flush_chunks(v["segments"], 250.0)


@query("stream_flush_windows", CHUNKS)
def _(v):
    """Turns of conversations as they arrive; a table of jobs says how many segments each has."""
    jobs = v["conversations"].groupBy("conv_id").agg(F.max("turn").alias("final"))
    turns = s.arriving(v.spark, f"{v.sf_dir}/conversations.parquet").join(jobs, "conv_id")
    arriving = turns.selectExpr("conv_id as transcript_id", "cast(turn as long) as idx", "length(text) / 2.0D as seconds", "turn = final as last")
    return s.to_table(s.stream_flush_windows(arriving, 250.0), "chunks")


@query("stream_index_upkeep", f"WITH {POSTINGS} SELECT * FROM postings")
def _(v):
    return s.stream_index_upkeep(s.arriving(v.spark, f"{v.sf_dir}/documents.parquet").select("doc_id", "text"))


@query("stream_restale", f"WITH {RANGES} SELECT deck, page_from, page_to, transcript_id, score FROM s WHERE transcript_id IS NOT NULL")
def _(v):
    """Lectures are stored first; then ids of pages arrive, and the courses that their vectors touch are matched anew."""
    sha = F.substring(F.sha2(F.concat_ws(",", "vec"), 256), 1, 16).alias("source_sha")
    kinds = [f"cast({c} as {k}) as {c}" for c, k in (("project_id", "long"), ("deck", "long"), ("page_no", "long"), ("transcript_id", "long"), ("vec", "array<double>"))]
    pages = v["page_vectors"].selectExpr("vec_id", "project_id", "deck", "page_no", "cast(null as long) as transcript_id", "vec").select("vec_id", *[F.expr(k) for k in kinds])
    come = s.arriving(v.spark, f"{v.sf_dir}/embeddings.parquet").select("vec_id")

    def store(folder):
        courses = s.MatchedCourses(v.spark, f"{folder}/courses", THRESHOLD, MARGIN)
        lectures = v["course_lecture_vectors"].selectExpr("cast(project_id as long) as project_id", "cast(transcript_id as long) as transcript_id", "cast(vec as array<double>) as vec")
        courses.apply(None, lectures.select("*", sha), 0, "lectures")
        return courses

    def content(named):
        return named.join(pages, "vec_id").select(F.lit("page").alias("kind"), *pages.columns[1:], sha, "__batch")

    return s.stream_restale(come, store, content=content).select("deck", "page_from", "page_to", "transcript_id", "score")


@query("stale_texts", "SELECT doc_id AS ref_id, substr(sha256(text), 1, 16) AS source_sha FROM documents WHERE length(text) >= 40 AND doc_id % 3 <> 0")
def _(v):
    """Texts that arrive without a stored vector of their content."""
    stored = v["documents"].where("doc_id % 3 = 0").selectExpr("doc_id as ref_id", "substring(sha2(text, 256), 1, 16) as source_sha")
    texts = s.arriving(v.spark, f"{v.sf_dir}/documents.parquet").selectExpr("doc_id as ref_id", "text")
    return s.to_table(joins.stale_vectors(texts, stored).select("ref_id", "source_sha"), "stale")
