"""Queries of sources, sinks and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import cards as c
from ..operators import ledger
from ..registry import query
from ..sources import readers, sinks
from ..sources.folders import shared_base
from ..sources.timed_text import LectureFiles
from .cleanup import MARKDOWN, SCANNED, raw_files
from .retrieval import FMT


@query("scan_segments_json", "SELECT transcript_id, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY idx) - 1 AS INTEGER) AS idx, start_s AS start, end_s AS \"end\", text FROM segments WHERE transcript_id % 5 <> 0")
def _(v):
    packed = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))))
    rows = v["segments"].groupBy("transcript_id").agg(packed.alias("segments"))
    return readers.scan_segments_json(rows.withColumn("segments", F.when(F.col("transcript_id") % 5 == 0, "{broken").otherwise(F.col("segments"))))


@query("scan_model_responses", """SELECT conv_id * 100 + turn AS id, CAST(0 AS INTEGER) AS pos, CASE WHEN turn % 4 = 3 THEN NULL ELSE role END AS front, CASE
  WHEN turn % 4 = 3 THEN NULL ELSE lang END AS back, turn % 4 <> 3 AS ok
FROM (SELECT *, concat('b', turn) AS lang FROM conversations)""")
def _(v):
    card = F.to_json(F.struct(F.col("role").alias("front"), F.concat(F.lit("b"), F.col("turn").cast("string")).alias("back")))
    whole = F.concat(F.lit('{"cards":['), card, F.lit("]}"))
    kind = F.col("turn") % 4
    content = F.when(kind == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Here you are: ["), card, F.lit("] bye"))).when(kind == 2, F.concat(F.lit("One: "), card)).otherwise("none at all {")
    return readers.scan_model_responses(v["conversations"].select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), content.alias("content")))


# every page as a file of a domain's kind: no folder of media is among the given tables
FILES = r"""files AS (SELECT DISTINCT path, string_split(path, '/')[-1] AS name, size FROM (SELECT concat('/media/page-', page_id, CASE WHEN page_id % 9 = 0 THEN '.tmp' ELSE '' END,
  '.', regexp_extract(lower(url), '^https?://[^/]*\.([a-z]+)', 1)) AS path, CAST(strlen(html) AS BIGINT) AS size FROM pages)),
inventory AS (SELECT path, name, regexp_extract(name, '\.([^.]+)$', 1) AS ext, size FROM files WHERE regexp_extract(name, '\.([^.]+)$', 1) IN ('com', 'org') AND NOT regexp_matches(name, '\.tmp'))"""


def inventory(v):
    name = F.concat(F.lit("/media/page-"), "page_id", F.when(F.col("page_id") % 9 == 0, ".tmp").otherwise(""), F.lit("."), F.regexp_extract(F.lower("url"), r"^https?://[^/]*\.([a-z]+)", 1))
    return readers.inventory(v["pages"].select(name.alias("path"), F.octet_length("html").cast("long").alias("length")), ["com", "org"])


@query("scan_media_inventory", f"WITH {FILES} SELECT name, ext, size FROM inventory")
def _(v):
    return inventory(v).select("name", "ext", "size")


@query("storage_usage", f"WITH {FILES} SELECT ext, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM inventory GROUP BY 1")
def _(v):
    return readers.storage_usage(inventory(v))


@query("sink_transcript_exports", f"""WITH {MARKDOWN} SELECT transcript_id, 'md' AS format, markdown AS content FROM md
UNION ALL SELECT transcript_id, 'txt' AS format, string_agg(text, chr(10) ORDER BY idx) AS content FROM segments GROUP BY 1
UNION ALL SELECT transcript_id, 'segments', string_agg(concat('[', {FMT}, '] ', text), chr(10) ORDER BY idx) FROM segments GROUP BY 1
UNION ALL SELECT transcript_id, 'json', concat('[', string_agg(CAST(json_object('start_s', start_s, 'end_s', end_s, 'text', text) AS VARCHAR), ',' ORDER BY idx), ']') FROM segments GROUP BY 1""")
def _(v):
    return sinks.transcript_exports(v["segments"])


MD = "concat('# ', title, chr(10), '> **', CAST(tokens_in AS VARCHAR), '** tokens of `', CAST(id AS VARCHAR), '`')"


@query("sink_summary_exports", f"""SELECT id, 'md' AS format, {MD} AS content FROM summaries
  UNION ALL SELECT id, 'txt', concat(title, chr(10), CAST(tokens_in AS VARCHAR), ' tokens of ', CAST(id AS VARCHAR)) FROM summaries""")
def _(v):
    md = F.concat(F.lit("# "), "title", F.lit("\n> **"), F.col("tokens_in").cast("string"), F.lit("** tokens of `"), F.col("id").cast("string"), F.lit("`"))
    return sinks.summary_exports(v["summaries"].select("id", md.alias("markdown")))


@query("sink_dump", """WITH s AS (SELECT project_id AS course, transcript_id AS id, concat('Lec', transcript_id % 7) AS slug FROM lectures),
n AS (SELECT *, row_number() OVER (PARTITION BY course, slug ORDER BY id) AS k FROM s),
body AS (SELECT transcript_id AS id, 'transcript.md' AS file, string_agg(text, chr(10) ORDER BY idx) AS content FROM segments GROUP BY 1
  UNION ALL SELECT transcript_id, 'summary.md', concat('# ', arg_max(title, (id, title))) FROM summaries GROUP BY 1)
SELECT concat('Course ', course, '/', slug, CASE WHEN k > 1 THEN concat('-', k) ELSE '' END, '/', file) AS path, content FROM n JOIN body USING (id)""")
def _(v):
    texts = v["segments"].groupBy("transcript_id").agg(sinks.ordered("text", "\n").alias("content"))
    newest = v["summaries"].groupBy("transcript_id").agg(F.concat(F.lit("# "), F.max_by("title", F.struct("id", "title"))).alias("summary"))
    rows = v["lectures"].selectExpr("concat('Course ', project_id) as course", "concat('Lec:', transcript_id % 7) as title", "transcript_id")
    return sinks.dump(rows.join(texts, "transcript_id").join(newest, "transcript_id", "left"))


CARDS = "SELECT run_id, pos, kind, front, back, slide, 'Course ' || project_id AS course, 'L' || run_id AS lecture, 'u' || run_id || '-' || pos AS uid FROM card_items WHERE pos % 4 <> 3"
FLAT = lambda x: rf"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"


def deck_cards(v):
    return v["card_items"].selectExpr("kind", "front", "back", "slide", "concat('Course ', project_id) as course", "concat('L', run_id) as lecture", "concat('u', run_id, '-', pos) as uid", "if(pos % 4 = 3, 'suspended', 'active') as status")


@query("sink_deck_tsv", f"""SELECT kind, uid, CASE WHEN kind = 'cloze' THEN concat({FLAT('front')}, chr(9), course, '::', lecture)
  ELSE concat({FLAT('front')}, chr(9), {FLAT('back')}, ' (slide ', slide, ')', chr(9), course, '::', lecture) END AS line FROM ({CARDS})""")
def _(v):
    return c.deck_lines(deck_cards(v))


@query("sink_note_table", f"""SELECT course || '::' || lecture AS deck, CAST(concat('0x', substr(sha256(course || '::' || lecture), 1, 8)) AS BIGINT) AS deck_id,
  substr(sha256(uid), 1, 10) AS guid, kind, front, back FROM ({CARDS})""")
def _(v):
    return c.note_table(deck_cards(v))


@query("scalar_functions", rf"""SELECT p_partkey, substr(regexp_replace(trim(regexp_replace(lower(p_name), '[^\p{{L}}\p{{N}}_\s-]+', ' ', 'g')), '\s+', '-', 'g'), 1, 60) AS slug,
  greatest(1, length(p_name) // 4) AS tokens, CASE
  WHEN p_size >= 60 THEN lpad(CAST(p_size // 3600 AS VARCHAR), 0, '0') || lpad(CAST(p_size // 60 % 60 AS VARCHAR), 2,
  '0') || ':' || lpad(CAST(p_size % 60 AS VARCHAR), 2, '0') ELSE '00:' || lpad(CAST(p_size AS VARCHAR), 2, '0') END AS stamp,
  round((p_partkey * 0.003::DOUBLE + 1000 * 0.15::DOUBLE + p_size * 0.6::DOUBLE) / 1000000, 6) AS cost FROM part""")
def _(v):
    return v["part"].select(
        "p_partkey", t.slug(F.col("p_name")).alias("slug"), t.estimate_tokens(F.col("p_name")).alias("tokens"), t.fmt_ts(F.col("p_size").cast("double")).alias("stamp"),
        ledger.estimate_cost(F.col("p_partkey"), F.lit(1000), F.col("p_size")).alias("cost"))


@query("summary_shape", """WITH w AS (SELECT doc_id, n_chars / 6.0 AS words, CASE lang WHEN 'en' THEN 7 WHEN 'fr' THEN 2 ELSE 4 END AS bullets FROM documents),
s AS (SELECT doc_id, bullets, least(12, greatest(5, CAST(round_even(words / 1200, 0) AS BIGINT))) AS topics FROM w)
SELECT doc_id, topics, topics + 1 AS sections, (topics + 1) * (25 + bullets * 22) AS words, least(8000, 3 * (topics + 1) * (25 + bullets * 22) + 1800) AS cap FROM s""")
def _(v):
    bullets = F.when(F.col("lang") == "en", 7).when(F.col("lang") == "fr", 2).otherwise(4)
    return summary_shape(v["documents"].select("doc_id", (F.col("n_chars") / 6.0).alias("source_words"), bullets.alias("bullets")))


def summary_shape(df, max_tokens: int = 8000):
    """Topics, sections, words and the token cap of a summary, from the words of its source."""
    topics = F.least(F.lit(12), F.greatest(F.lit(5), F.rint(F.col("source_words") / 1200).cast("long")))
    out = df.withColumn("topics", topics).withColumn("sections", F.col("topics") + 1).withColumn("words", F.col("sections") * (25 + F.col("bullets") * 22))
    return out.withColumn("cap", F.least(F.lit(max_tokens), 3 * F.col("words") + 1800)).drop("source_words", "bullets")


@query("scan_lecture_files", f"WITH {SCANNED} SELECT * FROM scanned")
def _(v):
    """Every lecture exported to a folder as a file with times, and the folder read again."""
    v.spark.dataSource.register(LectureFiles)
    folder = f"{shared_base(v.spark)}/lectures-{uuid.uuid4()}"
    files = raw_files(v).select(F.concat("path", F.lit(".txt")).alias("path"), F.col("value").alias("content"))
    files.write.format("lecture_files").mode("overwrite").save(folder)
    return v.spark.read.format("lecture_files").load(folder).withColumn("path", F.regexp_extract("path", r"([^/]*)\.txt$", 1))
