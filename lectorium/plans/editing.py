"""Queries of edit plans, cards, packing and table upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import cards as c
from ..operators import contexts
from ..operators import edits as e
from ..operators import joins, listings, timed
from ..operators import upkeep as u
from ..operators.needles import locate_needles
from ..registry import query
from .cleanup import SCANNED, raw_files
from .listings import LINKED, NUMBERS, SUMMARISED, linked, summarised

AL = r"[\p{L}\p{N}]"
RULES = "SELECT id AS rule_id, p.project_id, find, repl, auto FROM terms, (SELECT DISTINCT project_id FROM segments) p"
OCC = rf"""occ AS (SELECT r.rule_id, s.project_id, s.transcript_id, s.idx, CAST(i - 1 AS INTEGER) AS start, CAST(i - 1 + length(find) AS INTEGER) AS stop
  FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM segments) s JOIN ({RULES}) r USING (project_id)
  WHERE substr(text, i, length(find)) = find AND NOT (i > 1 AND regexp_matches(substr(text, i - 1, 1), '{AL}')) AND NOT regexp_matches(substr(text, i + length(find), 1), '{AL}'))"""


def rules(v):
    return v["segments"].select("project_id").distinct().crossJoin(F.broadcast(v["terms"])).withColumnRenamed("id", "rule_id")  # six fixed rules


def occurrences(v):
    return e.find_occurrences(v["segments"], rules(v))


@query("find_occurrences", f"WITH {OCC} SELECT rule_id, transcript_id, idx, start, stop FROM occ")
def _(v):
    return occurrences(v).withColumnRenamed("end", "stop")


#: The signs that count as plain ones, as SQL writes them.
PLAIN = "translate(%s, '‐‑‒–—−‘’′´`“”«»', '------' || repeat(chr(39), 5) || '\"\"\"\"')"
SIGNED = "concat('«', p_name, '»  −  ', p_brand, '’s ', p_size, '′ ‐‑', ' `', p_type, '´ “x” – ‘y’—z‒ ')"


@query("normalize_match", rf"SELECT p_partkey, trim(regexp_replace({PLAIN % SIGNED}, '\s+', ' ', 'g')) AS norm FROM part")
def _(v):
    return v["part"].select("p_partkey", t.normalize_match(F.expr(SIGNED)).alias("norm"))


PROPOSED = "(SELECT project_id, rule_id, find, repl FROM (%s) UNION ALL SELECT project_id, rule_id + 100, find, repl FROM (%s) WHERE rule_id <= 2 UNION ALL SELECT project_id, 200, 'zzz', 'y' FROM (%s) WHERE rule_id = 1)" % (RULES, RULES, RULES)


@query("check_proposals", f"""WITH {OCC}, n AS (SELECT project_id, rule_id, count(*) AS n FROM occ GROUP BY ALL),
p AS (SELECT p.*, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY p.project_id, find, repl ORDER BY p.rule_id) AS place FROM {PROPOSED} p LEFT JOIN n USING (project_id, rule_id)),
f AS (SELECT *, CASE WHEN place > 1 THEN 'duplicate' WHEN find = repl THEN 'noop' WHEN n = 0 THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS flag FROM p)
SELECT project_id, rule_id, flag, CASE WHEN flag IN ('ok', 'ambiguous') THEN n ELSE 0 END AS occurrences FROM f""")
def _(v):
    base = rules(v).selectExpr("project_id", "rule_id", "find", "repl")
    more = base.where("rule_id <= 2").selectExpr("project_id", "rule_id + 100", "find", "repl")
    none = base.where("rule_id = 1").selectExpr("project_id", "200", "'zzz'", "'y'")
    proposed = base.union(more).union(none)
    keyed = proposed.selectExpr("project_id", "project_id * 1000 + rule_id as rule_id", "find", "repl")
    found = e.check_proposals(keyed, e.find_occurrences(v["segments"], keyed))
    return found.selectExpr("project_id", "cast(rule_id - project_id * 1000 as int) as rule_id", "flag", "occurrences")


SETTLED = f"""{OCC}, o AS (SELECT *, row_number() OVER (PARTITION BY transcript_id, idx ORDER BY start, stop DESC, rule_id) AS n FROM occ),
settled AS (SELECT transcript_id, idx, n, rule_id, start, stop, start AS s0, stop AS e0, 'applied' AS status FROM o WHERE n = 1
  UNION ALL SELECT o.transcript_id, o.idx, o.n, o.rule_id, o.start, o.stop, CASE WHEN o.start >= s.e0 THEN o.start ELSE s.s0 END, CASE WHEN o.start >= s.e0 THEN o.stop ELSE s.e0 END,
    CASE WHEN o.start = s.s0 AND o.stop = s.e0 THEN 'duplicate_span' WHEN o.start < s.e0 THEN 'conflict' ELSE 'applied' END
  FROM settled s JOIN o ON o.transcript_id = s.transcript_id AND o.idx = s.idx AND o.n = s.n + 1)"""


@query("settle_spans", f"WITH RECURSIVE {SETTLED} SELECT transcript_id, idx, start, stop, CAST(rule_id AS BIGINT) AS rule_id, status FROM settled")
def _(v):
    return e.settle_spans(occurrences(v)).withColumnRenamed("end", "stop")


@query("apply_proposals", f"""WITH RECURSIVE {SETTLED}, a AS (SELECT transcript_id, idx, start, stop, repl, lag(stop, 1, 0) OVER (PARTITION BY transcript_id, idx ORDER BY start) AS prev,
    row_number() OVER (PARTITION BY transcript_id, idx ORDER BY start DESC) = 1 AS last FROM settled JOIN terms ON id = rule_id WHERE status = 'applied')
SELECT transcript_id, idx, string_agg(concat(substr(text, prev + 1, start - prev), repl, CASE WHEN last THEN substr(text, stop + 1) ELSE '' END), ''
  ORDER BY start) AS text, CAST(count(*) AS INTEGER) AS n_applied
FROM a JOIN segments USING (transcript_id, idx) GROUP BY ALL""")
def _(v):
    settled = e.settle_spans(occurrences(v))
    return e.apply_proposals(v["segments"].select("transcript_id", "idx", "text"), settled, v["terms"].withColumnRenamed("id", "rule_id"))


def glossary_sql(text: str) -> str:
    for find, repl in (("and", "&"), ("est", "EST"), ("of the", "OF-THE"), ("que", "que"), ("the", "THE")):  # in order of find
        for _ in (1, 2):  # neighbours share a boundary
            text = rf"regexp_replace({text}, '(^|[^\p{{L}}\p{{N}}]){find}($|[^\p{{L}}\p{{N}}])', '\1{repl}\2', 'g')"
    return text


@query("apply_glossary", f"SELECT project_id, transcript_id, idx, {glossary_sql('text')} AS text FROM segments")
def _(v):
    return e.apply_glossary(v["segments"], rules(v).withColumnRenamed("rule_id", "id")).drop("n_applied")


IMPORTED = f"""{SCANNED}, fixed AS (SELECT CAST(path AS BIGINT) AS transcript_id, idx, start, {glossary_sql('text')} AS text, {glossary_sql('text')} <> text AS revised FROM scanned),
dur AS (SELECT transcript_id, max(end_s) AS duration FROM segments GROUP BY 1),
x AS (SELECT *, max(start) OVER (PARTITION BY transcript_id ORDER BY idx) AS start_s FROM fixed JOIN dur USING (transcript_id))"""


@query("import_transcripts", f"""WITH {IMPORTED} SELECT transcript_id, idx, start_s, coalesce(lead(start_s) OVER w, greatest(duration, start_s)) AS end_s, text, revised,
  CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY transcript_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM x WINDOW w AS (PARTITION BY transcript_id ORDER BY idx)""")
def _(v):
    """Files with times, as they were written, over the segments that are stored."""
    files = raw_files(v).withColumn("transcript_id", F.col("path").cast("long"))
    files = files.join(v["lectures"].select("project_id", "transcript_id"), "transcript_id")
    done = timed.import_transcripts(files, rules(v).withColumnRenamed("rule_id", "id"), v["segments"])
    return done.select("transcript_id", "idx", "start_s", "end_s", "text", "revised", "offset")


@query("locate_across_segments", """WITH j AS (SELECT transcript_id, strpos(string_agg(text, ' ' ORDER BY idx), 'the th') - 1 AS place FROM segments GROUP BY 1),
s AS (SELECT transcript_id, idx, coalesce(sum(length(text) + 1) OVER (PARTITION BY transcript_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS lo, length(text) AS len FROM segments)
SELECT transcript_id, idx, CAST(place - lo AS BIGINT) AS local FROM s JOIN j USING (transcript_id) WHERE place >= 0 AND place BETWEEN lo AND lo + len""")
def _(v):
    return e.locate_across_segments(v["segments"], "the th")


NEEDLES = "SELECT * FROM (VALUES (1, 'the'), (2, 'and the'), (3, 'que'), (4, 'of the'), (5, 'a')) AS n(needle_id, find)"


@query("locate_needles", rf"""WITH p AS (SELECT transcript_id, idx, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM segments),
q AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY transcript_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo FROM p WHERE text <> ''),
j AS (SELECT transcript_id, string_agg(text, ' ' ORDER BY idx) AS t FROM q GROUP BY 1),
h AS (SELECT needle_id, transcript_id, i - 1 AS a, i - 1 + length(find) AS b FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM j), ({NEEDLES})
  WHERE substr(t, i, length(find)) = find AND NOT (i > 1 AND regexp_matches(substr(t, i - 1, 1), '{AL}')) AND NOT regexp_matches(substr(t, i + length(find), 1), '{AL}'))
SELECT needle_id, h.transcript_id, x.idx AS first_idx, a - x.lo AS first_at, y.idx AS last_idx, b - y.lo AS last_at FROM h
JOIN q x ON x.transcript_id = h.transcript_id AND a >= x.lo AND a < x.lo + length(x.text) JOIN q y ON y.transcript_id = h.transcript_id AND b > y.lo AND b <= y.lo + length(y.text)""")
def _(v):
    return locate_needles(v["segments"], v.spark.sql(NEEDLES))


KEY = "trim(regexp_replace(strip_accents(lower(trim(front))), '[^a-z0-9]+', ' ', 'g'))"
FORMULAS = r"list_transform(regexp_extract_all(concat_ws(' ', front, back), '\$([^$\n]{1,200})\$', 1), lambda x: regexp_replace(x, '\s+', '', 'g'))"
PARTS = r"regexp_extract_all(front, '(?s)\{\{c\d::(.+?)\}\}', 1)"
CLOZE = f"(len({PARTS}) BETWEEN 1 AND 2 AND len(list_filter({PARTS}, lambda p: trim(p) = '')) = 0)"
CARDS = f"""w AS (SELECT run_id, pos, {KEY} AS key, CASE WHEN slide = 1 THEN 1 END AS slide, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS n,
    CASE WHEN kind NOT IN ('qa', 'cloze') OR trim(front) = '' THEN 'malformed' WHEN kind = 'qa' AND trim(back) = '' THEN 'empty_back' WHEN kind = 'cloze' AND NOT {CLOZE} THEN 'bad_cloze'
      WHEN len(list_filter({FORMULAS}, lambda x: x NOT IN ('', 'x_0+1'))) > 0 THEN 'unverified_formula'
      WHEN {KEY} = '' OR EXISTS (SELECT 1 FROM card_items o WHERE o.run_id = card_items.run_id AND o.pos = 0 AND o.run_id % 3 = 0
  AND {KEY.replace('front', 'o.front')} = {KEY.replace('front', 'card_items.front')}) THEN 'duplicate' END AS r FROM card_items),
y AS (SELECT run_id, 0 AS n, CAST(-1 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS seen, 0 AS used, 0 AS accepted, 'start' AS reason, CAST(NULL AS INTEGER) AS slide FROM (SELECT DISTINCT run_id FROM w)
  UNION ALL SELECT w.run_id, w.n, w.pos, CASE WHEN q.why IS NULL THEN list_append(y.seen, w.key) ELSE y.seen END, y.used + CASE WHEN q.why IS NULL AND w.slide = 1 THEN 1 ELSE 0 END,
    y.accepted + CASE WHEN q.why IS NULL THEN 1 ELSE 0 END, q.why, w.slide
  FROM y JOIN w ON w.run_id = y.run_id AND w.n = y.n + 1, LATERAL (SELECT coalesce(w.r, CASE WHEN list_contains(y.seen, w.key) THEN 'duplicate' END, CASE
  WHEN w.slide = 1 AND y.used >= 2 THEN 'page_cap' END) AS why) q WHERE y.accepted < 4)"""


def verdicts(v):
    items = v["card_items"]
    old = items.where("pos = 0 and run_id % 3 = 0").select("run_id", t.dedup_key(F.trim("front")).alias("front_key"))
    known = items.select("run_id", F.lit("x_0+1").alias("formula")).distinct()
    pages = items.select("run_id", F.lit(1).alias("page")).distinct()
    return c.validate_cards(items, old, known, pages, cap=4)


@query("validate_cards", f"WITH RECURSIVE {CARDS} SELECT run_id, CAST(pos AS INTEGER) AS pos, reason, slide FROM y WHERE n > 0")
def _(v):
    return verdicts(v)


@query("cards", f"""WITH RECURSIVE {CARDS} SELECT run_id, count(*) FILTER (reason IS NULL) AS n_new, count(*) FILTER (reason = 'duplicate') AS n_dup,
  count(*) FILTER (reason IS NOT NULL AND reason <> 'duplicate') AS n_bad FROM y WHERE n > 0 GROUP BY 1""")
def _(v):
    return verdicts(v).groupBy("run_id").agg(F.count_if(F.col("reason").isNull()).alias("n_new"), F.count_if(F.col("reason") == "duplicate").alias("n_dup"), F.count_if(F.col("reason") != "duplicate").alias("n_bad"))


@query("dedup_key", f"SELECT run_id, pos, {KEY} AS key FROM card_items")
def _(v):
    return v["card_items"].select("run_id", "pos", t.dedup_key(F.trim("front")).alias("key"))


@query("cloze_valid", f"SELECT run_id, pos, {CLOZE} AS ok FROM card_items")
def _(v):
    return v["card_items"].select("run_id", "pos", t.cloze_valid(F.col("front")).alias("ok"))


@query("allowed_formulas", r"""SELECT DISTINCT source, formula
  FROM (SELECT source, regexp_replace(unnest(regexp_extract_all(text, '\$([^$\n]{1,200})\$', 1)), '\s+', '', 'g') AS formula FROM documents WHERE doc_id % 5 <> 0) WHERE formula <> ''""")
def _(v):
    return c.allowed_formulas(v["documents"].select("source", "text", (F.col("doc_id") % 5 == 0).alias("uncertain")), "source")


ANSWERS = "SELECT conv_id AS answer_id, conv_id % 10 AS project_id, concat('See [L', conv_id % 12 + 1, ' 12:40] and (L', turn + 1, ', L', conv_id % 25 + 1, ') or [L3].') AS text FROM conversations"


@query("citations", rf"""WITH {NUMBERS}, lab AS (SELECT project_id, transcript_id, concat('L', lecture_no) AS label
  FROM numbers), a AS (SELECT answer_id * 100 + row_number() OVER (PARTITION BY answer_id ORDER BY text) AS answer_id, project_id, text FROM ({ANSWERS})),
x AS (SELECT answer_id, project_id, -1 AS grp, unnest(regexp_extract_all(text, '\[(L\d+(?: \d+:\d\d)?)\]', 1)) AS c FROM a
  UNION ALL SELECT answer_id, project_id, 0, unnest(string_split(regexp_extract(text, '\((L\d+(?:, ?L\d+)*)\)', 1), ', ')) FROM a),
r AS (SELECT x.*, lab.label, transcript_id, CASE
  WHEN contains(c, ':') THEN CAST(regexp_extract(c, ' (\d+):', 1) AS BIGINT) * 60 + CAST(regexp_extract(c, ':(\d+)', 1) AS BIGINT) END AS at_seconds FROM x LEFT
  JOIN lab ON lab.project_id = x.project_id AND lab.label = string_split(c, ' ')[1])
SELECT answer_id, label, transcript_id, at_seconds FROM r WHERE transcript_id IS NOT NULL AND NOT (grp = 0 AND EXISTS (SELECT 1 FROM r b
  WHERE b.answer_id = r.answer_id AND b.grp = 0 AND b.transcript_id IS NULL))""")
def _(v):
    from pyspark.sql import Window

    text = F.concat(F.lit("See [L"), F.col("conv_id") % 12 + 1, F.lit(" 12:40] and (L"), F.col("turn") + 1, F.lit(", L"), F.col("conv_id") % 25 + 1, F.lit(") or [L3]."))
    rows = v["conversations"].select("conv_id", (F.col("conv_id") % 10).alias("project_id"), text.alias("text"))
    number = F.col("conv_id") * 100 + F.row_number().over(Window.partitionBy("conv_id").orderBy("text"))
    answers = rows.select(number.alias("answer_id"), "project_id", "text")
    return c.citations(answers, listings.lecture_numbers(v["lectures"]).select("project_id", "label", "transcript_id"))


CONTEXT = f"""{LINKED}, m AS (SELECT *, bool_or(link_source = 'manual') OVER (PARTITION BY transcript_id) AS has FROM linked),
b AS (SELECT transcript_id, rank, concat('[', deck, ' p.', page_no, '] ', substr(text, 1, 1800)) AS block FROM m WHERE link_source = 'manual' OR NOT has),
head AS (SELECT l.transcript_id, coalesce(title, '') AS title FROM lectures l
  LEFT JOIN (SELECT transcript_id, arg_max(title, (id, title)) AS title FROM summaries GROUP BY 1) USING (transcript_id)),
k AS (SELECT b.*, length(title) + sum(length(block)) OVER (PARTITION BY transcript_id ORDER BY rank) AS used FROM b JOIN head USING (transcript_id)),
p AS (SELECT transcript_id, string_agg(block, chr(10) ORDER BY rank) AS pages, count(*) AS n FROM k WHERE used <= 12000 GROUP BY 1),
ctx AS (SELECT transcript_id, concat_ws(chr(10), title, pages) AS context, coalesce(n, 0) AS n_pages FROM head LEFT JOIN p USING (transcript_id))"""


def context_table(v):
    """Per lecture: the title of its newest summary and, in what it leaves of the budget, its pages; confirmed links first."""
    newest = v["summaries"].groupBy("transcript_id").agg(F.max_by("title", F.struct("id", "title")).alias("title"))
    head = v["lectures"].select("transcript_id").join(newest, "transcript_id", "left").withColumn("title", F.coalesce("title", F.lit("")))
    block = F.concat(F.lit("["), "deck", F.lit(" p."), F.col("page_no").cast("string"), F.lit("] "), F.substring("text", 1, 1800))
    blocks = joins.manual_over_auto(linked(v)).select("transcript_id", "rank", block.alias("block")).withColumn("len", F.length("block").cast("long"))
    kept = joins.budget_prefix(blocks.join(head, "transcript_id"), "transcript_id", ["rank"], 12_000, F.length("title"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n")
    pages = kept.groupBy("transcript_id").agg(text.alias("pages"), F.count(F.lit(1)).alias("n"))
    return head.join(pages, "transcript_id", "left").select(
        "transcript_id", F.concat_ws("\n", "title", "pages").alias("context"), F.coalesce("n", F.lit(0)).cast("long").alias("n_pages")
    )


@query("context_table", f"WITH {CONTEXT} SELECT * FROM ctx")
def _(v):
    return context_table(v)


@query("run_estimate", f"WITH {CONTEXT} SELECT transcript_id, length(context) AS chars, greatest(1, length(context) // 4) + 1000 * least(n_pages, 3) AS tokens FROM ctx")
def _(v):
    return context_table(v).select("transcript_id", F.length("context").cast("long").alias("chars"), (t.estimate_tokens(F.col("context")) + 1000 * F.least("n_pages", F.lit(3))).alias("tokens"))


def block_sql(body: str) -> str:
    return f"concat('[', deck, ' p.', page_no, ']', chr(10), {body})"


BODY = r"trim(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'))"
SLIDES = f"""{LINKED}, mn AS (SELECT *, bool_or(link_source = 'manual') OVER (PARTITION BY transcript_id) AS has FROM linked),
bl AS (SELECT transcript_id, rank, {block_sql(f"substr({BODY}, 1, 1200)")} AS block FROM mn WHERE (link_source = 'manual' OR NOT has) AND {BODY} <> ''),
us AS (SELECT *, sum(length(block)) OVER (PARTITION BY transcript_id ORDER BY rank) AS used FROM bl),
sl AS (SELECT transcript_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS slides, count(*) AS n_pages FROM us WHERE used <= 6000 GROUP BY 1)"""


@query("summary_context_table", f"""WITH {SLIDES},
s AS (SELECT l.transcript_id, s.title AS prev, s.id, row_number() OVER (PARTITION BY l.transcript_id ORDER BY s.created_at DESC, s.id DESC) AS rank
  FROM lectures l JOIN lectures o ON l.project_id = o.project_id AND l.transcript_id <> o.transcript_id JOIN summaries s ON s.transcript_id = o.transcript_id),
before AS (SELECT transcript_id, string_agg(prev, chr(10) ORDER BY rank) AS previous FROM s WHERE rank <= 5 GROUP BY 1)
SELECT l.transcript_id, coalesce(n_name, '') AS course, coalesce(previous, '') AS previous, (SELECT string_agg(concat(find, ' = ', repl), '; ' ORDER BY find, id)
  FROM (SELECT * FROM terms WHERE auto = 1 ORDER BY find, id LIMIT 60)) AS glossary, coalesce(slides, '') AS slides, coalesce(n_pages, 0) AS n_pages
FROM lectures l LEFT JOIN nation ON n_nationkey = l.project_id LEFT JOIN before USING (transcript_id) LEFT JOIN sl USING (transcript_id)""")
def _(v):
    courses = v["nation"].selectExpr("n_nationkey as project_id", "n_name as course_name")
    return contexts.summary_context(v["lectures"], courses, listings.previous_lectures(v["lectures"], v["summaries"]), v["terms"], linked(v))


@query("guide_context_table", f"""WITH {SUMMARISED}, b AS (SELECT project_id, deck, page_no, {block_sql(BODY)} AS block FROM slide_pages WHERE kind = 'exam' AND {BODY} <> ''),
e AS (SELECT *, sum(length(block)) OVER (PARTITION BY project_id ORDER BY deck, page_no) AS used FROM b),
x AS (SELECT project_id, string_agg(block, chr(10) || chr(10) ORDER BY deck, page_no) AS exams, count(*) AS n_pages FROM e WHERE used <= 40000 GROUP BY 1)
SELECT project_id, coalesce(notes, '') AS notes, coalesce(n_lectures, 0) AS n_lectures, coalesce(exams, '') AS exams, coalesce(n_pages, 0) AS n_pages FROM notes FULL JOIN x USING (project_id)""")
def _(v):
    return contexts.guide_context(contexts.lecture_notes(summarised(v)), joins.exam_pages(v["slide_pages"]))


@query("compression_ratio", r"""SELECT doc_id, n, round(n_chars / 6.0 / n, 4) AS ratio, n > 1.5 * 300 AS overshoot
  FROM (SELECT *, len(list_filter(regexp_split_to_array(translate(text, '#*`>|-', '      '), '[ \t\n\r\f]+'), lambda x: x <> '')) AS n FROM documents) WHERE n > 0""")
def _(v):
    n = t.word_count(F.col("text")).cast("long")
    return v["documents"].select("doc_id", "n_chars", n.alias("n")).where("n > 0").select("doc_id", "n", F.round(F.col("n_chars") / 6.0 / F.col("n"), 4).alias("ratio"), (F.col("n") > 450).alias("overshoot"))


@query("checklist_score", """WITH k AS (SELECT * FROM (VALUES ('greeting', 'the'), ('article', '(?i)de la'), ('digits', '[0-9]{2}')) AS k(name, pattern))
SELECT doc_id, count(*) FILTER (regexp_matches(text, pattern)) AS found, count(*) AS total, coalesce(string_agg(name, ','
  ORDER BY name) FILTER (NOT regexp_matches(text, pattern)), '') AS missing FROM documents, k GROUP BY doc_id""")
def _(v):
    checks = {"greeting": "the", "article": "(?i)de la", "digits": "[0-9]{2}"}
    hits = {k: F.col("text").rlike(p) for k, p in checks.items()}
    missing = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(~h, F.lit(k)) for k, h in hits.items()]))), ",")
    return v["documents"].select("doc_id", sum(h.cast("long") for h in hits.values()).alias("found"), F.lit(len(checks)).cast("long").alias("total"), missing.alias("missing"))


FRESH = "SELECT -1 - id AS id, deck, page_from, page_to + id % 2 AS page_to, transcript_id, 0.9 AS score FROM slide_links"


@query("refresh_auto_links", f"""WITH f AS ({FRESH}), d AS (SELECT DISTINCT deck FROM f WHERE deck <> 'src3')
SELECT id, deck, page_from, page_to, transcript_id, CAST(score AS DOUBLE) AS score, link_source FROM slide_links l WHERE link_source = 'manual' OR deck NOT IN (SELECT deck FROM d)
UNION ALL SELECT id, deck, page_from, page_to, transcript_id, 0.9, 'auto' FROM f WHERE deck IN (SELECT deck FROM d) AND NOT EXISTS (SELECT 1 FROM slide_links m
  WHERE m.link_source = 'manual' AND m.deck = f.deck AND m.page_from = f.page_from AND m.page_to = f.page_to)""")
def _(v):
    links = v["slide_links"].withColumn("score", F.col("score").cast("double"))
    fresh = links.selectExpr("-1 - id as id", "deck", "page_from", "page_to + id % 2 as page_to", "transcript_id", "cast(0.9 as double) as score")
    return u.refresh_auto_links(links, fresh, fresh.where("deck <> 'src3'").select("deck").distinct())


@query("upsert_keyed", """WITH e AS (SELECT transcript_id, kind, id, tokens_in, finished_at FROM jobs)
SELECT transcript_id, kind, max(id) AS id, arg_max(tokens_in, id) AS tokens_in, arg_max(finished_at, id) FILTER (finished_at IS NOT NULL) AS finished_at FROM e GROUP BY ALL""")
def _(v):
    rows = v["jobs"].select("transcript_id", "kind", "id", "tokens_in", "finished_at")
    return u.upsert_keyed(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0"), ["transcript_id", "kind"], "id", keep=["finished_at"])


@query("accept_links", "SELECT id, deck, CASE WHEN id % 7 = 1 THEN 'manual' ELSE link_source END AS link_source FROM slide_links")
def _(v):
    return u.accept_links(v["slide_links"], v["slide_links"].where("id % 7 = 1")).select("id", "deck", "link_source")


OWNED = "SELECT run_id AS transcript_id, project_id, pos, front, pos % 3 = 0 AS edited FROM card_items"


def owned(v):
    return v["card_items"].selectExpr("run_id as transcript_id", "project_id", "pos", "front", "pos % 3 = 0 as edited")


@query("replace_generated_cards", f"""WITH o AS ({OWNED}) SELECT transcript_id, pos, front, edited FROM o WHERE edited OR transcript_id % 2 = 1
UNION ALL SELECT transcript_id, pos + 100, concat('new ', front), false FROM o WHERE transcript_id % 2 = 0""")
def _(v):
    cards = owned(v).drop("project_id")
    return u.replace_generated_cards(cards, cards.where("transcript_id % 2 = 0").selectExpr("transcript_id", "pos + 100 as pos", "concat('new ', front) as front", "false as edited"))


@query("existing_fronts", f"""WITH o AS ({OWNED}) SELECT project_id, front,
  CASE WHEN count(*) FILTER (edited) = 0 AND count(DISTINCT transcript_id) = 1 THEN min(transcript_id) END AS except_transcript_id FROM o GROUP BY ALL""")
def _(v):
    return u.existing_fronts(owned(v))


@query("mark_interrupted", "SELECT id, CASE status WHEN 'running' THEN 'interrupted' ELSE status END AS status FROM jobs")
def _(v):
    return u.mark_interrupted(v["jobs"]).select("id", "status")


@query("cache_check", """SELECT transcript_id, sha256(concat('{"chars":', CAST(chars AS BIGINT), ',"n_segments":', n_segments, '}')) AS fingerprint, transcript_id % 2 = 0 AND transcript_id % 3 = 0 AS cached FROM lectures""")
def _(v):
    contexts = v["lectures"].select("transcript_id", F.col("chars").cast("long").alias("chars"), "n_segments")
    print_ = F.sha2(F.to_json(F.struct("chars", "n_segments")), 256)
    good = contexts.where("transcript_id % 2 = 0").select("transcript_id", F.lit(1).alias("run_id"), F.lit("ok").alias("status"), F.when(F.col("transcript_id") % 3 == 0, print_).otherwise("old").alias("fingerprint"))
    later = good.selectExpr("transcript_id", "2 as run_id", "'failed' as status", "'other' as fingerprint")
    return u.cache_check(contexts, good.union(later), "transcript_id")
