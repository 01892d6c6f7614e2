"""Literal cases of the operators."""

import pytest
from pyspark.sql import functions as F

from lectorium.functions import text as t
from lectorium.operators import cards, cleanup, edits, joins, ledger, listings, matching, timed, upkeep
from lectorium.operators import search as s
from lectorium.sources import readers, sinks


def pages(spark, labels, scores=None):
    rows = [(1, i + 1, a, (scores or [0.5] * len(labels))[i]) for i, a in enumerate(labels)]
    return spark.createDataFrame(rows, "deck long, page_no int, transcript_id long, score double")


A, B, N = 1, 2, None


@pytest.mark.parametrize(
    ("labels", "scores", "want"),
    [
        ([A, A, A, B, A, A, A], None, [A] * 7),  # inside a block: absorbed
        ([A, A, A, B, 3, 3, 3], None, [A, A, A, N, 3, 3, 3]),  # between two others: contested
        ([B, B, A, A, A], None, [B, B, A, A, A]),  # at the edge: stays
        ([A, A, A, N, A, A, A], [0.5] * 3 + [0.0] + [0.5] * 3, [A] * 7),  # a hole between equals, whatever it resembles
        ([N, A, A, A], [0.3, 0.5, 0.5, 0.5], [A] * 4),  # a hole at the edge that resembles something
        ([N, A, A, A], [0.0, 0.5, 0.5, 0.5], [N, A, A, A]),  # one that does not
        ([A, A, A, N, A, A, A], [0.5] * 3 + [0.7] + [0.5] * 3, [A, A, A, N, A, A, A]),  # ambiguous
        ([A, A, A, N, B, N, A, A, A], [0.5, 0.5, 0.5, 0.1, 0.5, 0.1, 0.5, 0.5, 0.5], [A, A, A, N, B, N, A, A, A]),  # direct neighbours only
        ([A, A, N, B, B], [0.5, 0.5, 0.2, 0.5, 0.5], [A, A, N, B, B]),
    ],
)
def test_smoothing(spark, labels, scores, want):
    got = matching.smooth_runs(pages(spark, labels, scores), 3, 0.6).orderBy("page_no").collect()
    assert [r.transcript_id for r in got] == want


def test_smoothing_invents_no_lecture_and_ranges_are_disjoint(spark):
    labels = [A, N, B, B, N, N, A, A, A, B, A, N, 3, 3, 3, N, 3]
    out = matching.smooth_runs(pages(spark, labels), 3)
    assert {r.transcript_id for r in out.collect()} <= {A, B, 3, N}
    ranges = sorted((r.page_from, r.page_to) for r in matching.page_ranges(out).collect())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_best_match_needs_threshold_and_margin(spark):
    scores = spark.createDataFrame(
        [(0, 1, 1, 10, 0.9), (0, 1, 1, 11, 0.5), (0, 1, 2, 10, 0.7), (0, 1, 2, 11, 0.69), (0, 1, 3, 10, 0.4), (0, 1, 4, 10, -0.5), (0, 1, 4, 11, -0.6)],
        "project_id int, deck int, page_no int, transcript_id long, score double",
    )
    every = spark.createDataFrame([(1, i) for i in range(1, 6)], "deck int, page_no int")
    got = matching.best_page_match(scores, every).orderBy("page_no").collect()
    assert [(r.transcript_id, r.score) for r in got] == [(10, 0.9), (None, 0.7), (None, 0.4), (None, 0.0), (None, 0.0)]


def test_timed_text(spark):
    raw = "[00:05] uno due tre\nquattro\n[01:10] x\n[1:00:00] fine"
    files = spark.createDataFrame([("a", raw), ("b", "intro\nmore\n[00:10] body"), ("c", "no times\nat all")], "path string, value string")
    got = {(r.path, r.idx): r for r in timed.scan_timed_text(files).collect()}
    assert [(got["a", i].start, got["a", i].end, got["a", i].text) for i in range(3)] == [(5, 70, "uno due tre\nquattro"), (70, 3600, "x"), (3600, 3600, "fine")]
    assert [got["a", i].offset for i in range(3)] == [0, 20, 22]
    assert got["b", 0].text == "intro more body" and got["b", 0].start == 10
    assert (got["c", 0].text, got["c", 0].start, got["c", 0].ts) == ("no times\nat all", 0.0, False)


def test_retiming_interpolates(spark):
    old = spark.createDataFrame([(1, 0, 0.0, 300.0), (1, 1, 300.0, 300.0)], "transcript_id long, idx int, start_s double, end_s double")
    lines = spark.createDataFrame([(1, i, f"line {i}", None) for i in range(4)], "transcript_id long, idx int, text string, at double")
    spread = timed.retime_segments(lines, old.where("false")).orderBy("idx").collect()
    assert [r.start_s for r in spread] == [0, 1, 2, 3]
    kept = timed.retime_segments(lines, old).orderBy("idx").collect()
    assert [r.start_s for r in kept] == [0, 300, 300, 300] and kept[-1].end_s == 300
    anchored = spark.createDataFrame([(1, 0, "a", 0.0), (1, 1, "b", None), (1, 2, "c", None), (1, 3, "d", 90.0)], lines.schema)
    assert [r.start_s for r in timed.retime_segments(anchored, old.where("false")).orderBy("idx").collect()] == [0, 30, 60, 90]


def test_paged_text_never_splits_a_block(spark):
    docs = spark.createDataFrame([(1, "aaaa\n\nbbbb\n\ncccccccccccc\n\nd"), (2, None), (3, "\n\n")], "doc_id long, text string")
    got = timed.scan_paged_text(docs, 10).orderBy("doc_id", "page_no").collect()
    assert [(r.doc_id, r.page_no, r.text) for r in got] == [(1, 1, "aaaa\n\nbbbb"), (1, 2, "cccccccccccc"), (1, 3, "d")]


def test_paged_text_trims_spaces_only(spark):
    """A block keeps the digit that is its place among the blocks."""
    docs = spark.createDataFrame([(1, "0 zero 0\n 1 one 1 \n22")], "doc_id long, text string")
    assert [r.text for r in timed.scan_paged_text(docs, 100, "\n").collect()] == ["0 zero 0\n1 one 1\n22"]


def segments(spark, *texts):
    return spark.createDataFrame([(0, 1, i, x) for i, x in enumerate(texts)], "project_id int, transcript_id int, idx int, text string")


def rules(spark, *pairs):
    return spark.createDataFrame([(0, i + 1, a, b, 1) for i, (a, b) in enumerate(pairs)], "project_id int, rule_id int, find string, repl string, auto int")


def test_occurrences_are_tolerant_and_whole_words(spark):
    seg = segments(spark, "we use pie  torch today", "pie torches", "it’s “pie torch”", "a.b axb", None)
    got = edits.find_occurrences(seg, rules(spark, ("pie torch", "PyTorch"), ("it's", "it is"), ("a.b", "c"), ("  ", "x"))).orderBy("rule_id", "idx").collect()
    assert [(r.rule_id, r.idx, r.start, r.end) for r in got] == [(1, 0, 7, 17), (1, 2, 6, 15), (2, 2, 0, 4), (3, 3, 0, 3)]


def test_overlaps_conflict_and_equal_spans_repeat(spark):
    seg, rs = segments(spark, "deep learning model"), rules(spark, ("deep learning", "DL"), ("learning model", "LM"), ("deep learning", "Deep"), ("model", "Model"))
    settled = edits.settle_spans(edits.find_occurrences(seg, rs))
    assert {r.rule_id: r.status for r in settled.collect()} == {1: "applied", 2: "conflict", 3: "duplicate_span", 4: "applied"}
    assert [r.text for r in edits.apply_proposals(seg, settled, rs).collect()] == ["DL Model"]


def test_proposal_flags(spark):
    seg = segments(spark, "one two two three")
    rs = rules(spark, ("one", "1"), ("one", "1"), ("two", "2"), ("zero", "0"), ("three", "three"), ("three", "x" * 200), (" ", "y"))
    flags = edits.check_proposals(rs, edits.find_occurrences(seg, rs)).orderBy("rule_id").collect()
    assert [r.flag for r in flags] == ["ok", "duplicate", "ambiguous", "unmatched", "noop", "too_large", "unmatched"]


def test_glossary_rules_chain_and_escape(spark):
    terms = rules(spark, ("a", "b"), ("b", "$1\\"), ("c", "never")).withColumn("auto", F.when(F.col("rule_id") < 3, 1).otherwise(0)).withColumnRenamed("rule_id", "id")
    row = edits.apply_glossary(segments(spark, "a b c"), terms).collect()[0]
    assert (row.text, row.n_applied) == ("$1\\ $1\\ c", 3)


def test_cards(spark):
    items = [(1, i, *x) for i, x in enumerate([("qa", "Cos'è A?", "x", 1), ("qa", "cos e a", "y", 1), ("qa", "B", "", 1), ("cloze", "no", "", 1), ("cloze", "{{c1::6}} ok", "", 1), ("essay", "C", "d", 1),
             ("qa", "D $x$", "e", 1), ("qa", "E", "f", 1), ("qa", "E", "g", 9), ("qa", "F", "h", None), ("qa", "old", "i", 2)])]
    df = spark.createDataFrame(items, "run_id int, pos int, kind string, front string, back string, slide int")
    old, formulas, known = (spark.createDataFrame(rows, schema) for rows, schema in (([(1, "old")], "run_id int, k string"), ([(1, "y")], "run_id int, f string"), ([(1, 1), (1, 2)], "run_id int, p int")))
    got = cards.validate_cards(df, old, formulas, known).orderBy("pos").collect()
    assert [r.reason for r in got] == [None, "duplicate", "empty_back", "bad_cloze", None, "malformed", "unverified_formula", "page_cap", None, None, "duplicate"]
    assert got[8].slide is None
    assert cards.validate_cards(df, old, formulas, known, cap=1).count() == 1


def test_boilerplate_and_vocabulary(spark):
    rows = [("d", i, f"body {i}\nFooter  2024\n{i}\n-") for i in range(1, 5)]
    got = cleanup.strip_boilerplate(spark.createDataFrame(rows, "deck string, page_no int, text string"))
    assert sorted(r.text for r in got.collect()) == [f"body {i}" for i in range(1, 5)]
    slides = spark.createDataFrame(
        [(0, i, "slides", x) for i, x in enumerate(["GEMM and WHAT II Abernathy-Utterback PyTorch", "what GEMM II WHAT Abernathy-Utterback PyTorch", "Once"])], "project_id int, doc_id int, kind string, text string"
    )
    none = spark.createDataFrame([(0, 1, "tensor core", 1)], "project_id int, id int, repl string, auto int")
    assert [r.term for r in cleanup.course_vocabulary(slides, none).orderBy("rank").collect()] == ["tensor core", "Abernathy-Utterback", "GEMM"]


def test_costs(spark):
    one = lambda h, m, o: spark.range(1).select(ledger.estimate_cost(*[F.lit(x).cast("long") for x in (h, m, o)]).alias("c")).first().c
    assert [one(0, 10**6, 0), one(10**6, 0, 0), one(0, 0, 10**6), one(None, None, None), one(0, 0, 0)] == [0.15, 0.003, 0.60, None, None]


def test_queue_eta(spark):
    running = spark.createDataFrame([], "project_id int, eta double")
    queued = spark.createDataFrame([(1, "transcribe", 600.0), (1, "llm_summary", None)], "project_id int, kind string, duration double")
    done = spark.createDataFrame([], "project_id int, id int, speed double")
    assert listings.queue_eta(running, queued, done).first().eta_s == 600 / 10 + 20 + 40


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, 4), (1, 2, 9), (1, 3, 1)], "k int, rank int, len long")
    assert [r["rank"] for r in joins.budget_prefix(df, "k", ["rank"], 10).collect()] == [1]


def test_low_coverage(spark):
    rows = [(1, i, 1200.0, 4000 if i else 900) for i in range(4)] + [(2, 9, 60.0, 5)]
    got = {r.transcript_id: r.low_coverage for r in listings.low_coverage(spark.createDataFrame(rows, "project_id int, transcript_id int, duration double, chars long")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 9: False}


def test_responses(spark):
    rows = [(1, '```json\n{"cards":[{"front":"a","back":"b"}]}\n```'), (2, 'text {x} [{"front":"c","back":"d"},{"front":"e"}] rest'), (3, 'ok {"front":"f","back":"g"}'), (4, "nothing"), (5, None)]
    got = readers.scan_model_responses(spark.createDataFrame(rows, "id long, content string")).orderBy("id", "pos").collect()
    assert [(r.id, r.pos, r.front, r.ok) for r in got] == [(1, 0, "a", True), (2, 0, "c", True), (2, 1, "e", True), (3, 0, "f", True), (4, 0, None, False), (5, 0, None, False)]


def test_upkeep(spark):
    links = spark.createDataFrame([(1, "d", 1, 5, "manual"), (2, "d", 6, 9, "auto"), (3, "e", 1, 2, "auto")], "id int, deck string, page_from int, page_to int, link_source string")
    fresh = spark.createDataFrame([(9, "d", 1, 5), (10, "d", 7, 9)], "id int, deck string, page_from int, page_to int")
    got = upkeep.refresh_auto_links(links, fresh, fresh.select("deck").distinct())
    assert sorted(r.id for r in got.collect()) == [1, 3, 10]


def test_exports(spark, tmp_path):
    rows = [("C", "x", 1, "a"), ("C", "x", 2, "b"), ("C", "x-2", 3, "c"), ("D", "x", 4, "d")]
    got = sinks.dump(spark.createDataFrame(rows, "course string, title string, transcript_id int, content string"))
    paths = [r.path for r in got.collect()]
    assert len(set(paths)) == 4 and "D/x/transcript.md" in paths
    sinks.write_text(got.selectExpr("content", "'t' as format"), str(tmp_path / "out"), ["format"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b", "c", "d"]


def test_scalars(spark):
    md = "<plan>x</plan>\nnoise\n# Title\nbody"
    row = spark.range(1).select(
        t.strip_plan(F.lit(md)).alias("plan"), t.unwrap(F.lit("```md\n# A\n## b\n```")).alias("unwrapped"), t.title(F.lit(md), F.lit("f")).alias("title"),
        t.word_count(F.lit("# a **b** c-d")).alias("n"), t.fmt_ts(F.lit(3725.9)).alias("ts"), t.dedup_key(F.lit("Perché, NO?")).alias("key"), t.cloze_valid(F.lit("{{c1:: }}")).alias("cloze"),
    ).first()
    assert tuple(row) == ("# Title\nbody", "# A\n## b", "Title", 4, "01:02:05", "perche no", False)


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "Più veloce del previsto, più veloce"), (2, "veloce più"), (3, "altro")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "piu VELOCE")], "query_id int, text string")
    got = s.phrase_search(s.build_postings(docs), q).collect()
    assert [(r.doc_id, r.tf, r.place) for r in got] == [(1, 2, 0)]


def test_more_scalars(spark):
    long = "x" * 50
    md = "# T\n\nfirst **para**\nline `two`\n\nnext\n## A\nbody a\n## B\n"
    row = spark.range(1).select(
        t.unwrap_json(F.lit('{"a":1,"notes":"%s","text":"no"}' % long)).alias("a"), t.unwrap_json(F.lit('{"notes":"short"}')).alias("b"), t.unwrap_json(F.lit("{bad")).alias("c"),
        t.overview(F.lit(md)).alias("d"), t.overview(F.lit("# T\n## next\nx")).alias("e"), t.language_name(F.lit("it-IT")).alias("f"), t.language_name(F.lit("xx")).alias("g"),
        t.language_name(F.lit(None).cast("string")).alias("h"), F.to_json(t.sections(F.lit(md))).alias("i"), t.job_speed(F.lit(30.0), F.lit(10.0), F.lit(2.0)).alias("j"),
        t.job_progress(F.lit(5.0), F.lit(0.0)).alias("k"), t.job_eta(F.lit(30.0), F.lit(90.0), F.lit(10.0)).alias("l"),
    ).first()
    same = "the same language as the transcript"
    assert tuple(row) == (long, '{"notes":"short"}', "{bad", "first para line two", "", "Italian", f"{same} (xx)", same, '[{"title":"A","body":"body a"},{"title":"B","body":""}]', 10.0, 0.0, 6.0)


@pytest.mark.parametrize(("text", "clipped", "images", "want"), [("", False, 0, True), ("plain words here", False, 0, False), ("plain", True, 0, True), ("x^2", False, 0, True), ("α", False, 0, True),
                                                                 ("a\nb\nc\nd\ne\nlong line here", False, 0, True), ("short", False, 1, True), ("w " * 200, False, 1, False)])
def test_review(spark, text, clipped, images, want):
    assert spark.range(1).select(cleanup.page_needs_review(F.lit(text), F.lit(clipped), F.lit(images)).alias("r")).first().r is want


def test_views_leave_the_users_own_alone(spark):
    from lectorium.sources.views import SPARK_VIEWS, Views

    spark.range(3).createOrReplaceTempView("documents")
    views = Views(spark, "/root/testdata/sf0.001")
    for name in SPARK_VIEWS:
        assert views[name].limit(1).count() == 1
    assert spark.table("documents").count() == 3 and [t.name for t in spark.catalog.listTables() if t.isTemporary] == ["documents"]
    spark.catalog.dropTempView("documents")
