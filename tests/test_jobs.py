"""Composed jobs on small literal tables."""

from pyspark.sql import functions as F

from lectorium.operators import contexts, timed


def test_import_parses_corrects_and_times(spark):
    """Terms apply to the parsed text with any sign for a sign; times come from the file, else from what was stored."""
    files = spark.createDataFrame([("a", "[00:02] it−s the pie torch\nand pie  torch\n[00:08] done", 1, 7), ("b", "no time here", 2, 8)], "path string, value string, project_id long, transcript_id long")
    terms = spark.createDataFrame([(1, 1, "pie torch", "PyTorch", 1), (1, 2, "it-s", "it is", 1), (1, 3, "done", "DONE", 0), (2, 4, "time", "time", 1)], "project_id long, id int, find string, repl string, auto int")
    stored = spark.createDataFrame([(7, 0, 1.0, 5.0), (7, 1, 5.0, 20.0)], "transcript_id long, idx int, start_s double, end_s double")
    done = timed.import_transcripts(files, terms, stored)
    got = sorted((r.transcript_id, r.idx, r.start_s, r.end_s, r.text, r.offset, r.revised, r.n_applied) for r in done.collect())
    assert got == [(7, 0, 2.0, 8.0, "it is the PyTorch\nand PyTorch", 0, True, 3), (7, 1, 8.0, 20.0, "done", 30, False, 0), (8, 0, 0.0, 0.0, "no time here", 0, False, 1)]
    assert sorted((r.transcript_id, r.n_applied) for r in timed.revisions(done).collect()) == [(7, 3), (8, 1)]


PAGES = "id long, transcript_id long, deck string, page_no long, text string, link_source string, rank int"


def test_slides_stop_at_the_budget_and_confirmed_ones_come_alone(spark):
    pages = [(1, 1, "d", 1, "a  \t b" + "x" * 2000, "auto", 1), (2, 1, "d", 2, "   ", "auto", 2), (3, 1, "d", 3, "c", "auto", 3), (4, 2, "e", 1, "auto page", "auto", 1), (5, 2, "e", 2, "mine", "manual", 2)]
    got = {r.transcript_id: (r.slides, r.n_pages) for r in contexts.slide_excerpts(spark.createDataFrame(pages, PAGES), budget=1210, per_page=1200).collect()}
    assert got == {1: ("[d p.1]\n" + ("a b" + "x" * 2000)[:1200], 1), 2: ("[e p.2]\nmine", 1)}
    assert contexts.slide_excerpts(spark.createDataFrame(pages, PAGES), budget=1300).where("transcript_id = 1").first().n_pages == 2


def test_a_summary_reads_sixty_spellings_and_its_course(spark):
    lectures = spark.createDataFrame([(1, 5), (9, 6)], "project_id long, transcript_id long")
    courses = spark.createDataFrame([(1, "Systems")], "project_id long, course_name string")
    previous = spark.createDataFrame([(5, 2, "older"), (5, 1, "newer")], "transcript_id long, rank int, prev_title string")
    terms = spark.createDataFrame([(i, f"t{i:03}", "x", i % 2) for i in range(200)], "id int, find string, repl string, auto int")
    rows = {r.transcript_id: r for r in contexts.summary_context(lectures, courses, previous, terms, spark.createDataFrame([], PAGES)).collect()}
    assert (rows[5].course, rows[5].previous, rows[6].course, rows[6].previous, rows[6].n_pages) == ("Systems", "newer\nolder", "", "", 0)
    assert rows[5].glossary == "; ".join(f"t{i:03} = x" for i in range(1, 121, 2))


def test_guides_and_answers_read_notes(spark):
    summarised = spark.createDataFrame([(1, 1, "L1", "One", "n" * 20), (1, 2, "L2", "Two", None)], "project_id long, lecture_no int, label string, title string, markdown string")
    notes = contexts.lecture_notes(summarised, chars=5)
    text = '<lecture id="L1" title="One">\nnnnnn\n</lecture>\n\n<lecture id="L2" title="Two">\n\n</lecture>'
    exams = spark.createDataFrame([(1, "d", 1, "e" * 30), (1, "d", 2, "f" * 30), (2, "d", 1, "only an exam")], "project_id long, deck string, page_no long, text string")
    guide = {r.project_id: tuple(r)[1:] for r in contexts.guide_context(notes, exams, budget=50).collect()}
    assert guide == {1: (text, 2, "[d p.1]\n" + "e" * 30, 1), 2: ("", 0, "[d p.1]\nonly an exam", 1)}
    passages = spark.createDataFrame([(7, 1, "L2", 61.0, "second"), (7, 2, "L1", 3.0, "first")], "query_id long, place int, label string, start_s double, text string")
    questions = spark.createDataFrame([(1, 7), (1, 8), (2, 9)], "project_id long, query_id long")
    answers = {r.query_id: (r.context, r.sources) for r in contexts.answer_context(questions, passages, notes).collect()}
    assert answers == {7: (text + "\n\n[L2 01:01] second\n[L1 00:03] first", "L1,L2"), 8: (text, "")}  # no course 2: it has no lecture to ask
    assert contexts.answer_context(questions.where(F.lit(False)), passages, notes).collect() == []
