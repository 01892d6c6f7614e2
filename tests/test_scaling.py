"""Steps that must not grow with the square of a deck, a text or an index: the same results, with less work on the way."""

from pyspark.sql import functions as F

from lectorium.operators import cleanup, joins, search


def test_links_meet_their_pages_only(spark):
    """Ranges over several stretches, past the deck's end, the wrong way round and of a deck without pages."""
    pages = spark.range(1, 400).selectExpr("if(id % 2 = 0, 'a', 'b') as deck", "id as page_no", "'t' as text", "'slides' as kind")
    given = [(1, "a", 1, 200), (2, "a", 63, 65), (3, "b", 390, 10**12), (4, "b", 9, 3), (5, "c", 1, 9), (6, "a", -(10**12), 3)]
    links = spark.createDataFrame([(*x, x[0], 0.5, "auto") for x in given], "id long, deck string, page_from long, page_to long, transcript_id long, score double, link_source string")
    got = joins.link_pages_join(links, pages)
    want = {(i, p) for i, deck, lo, hi in given for p in range(1, 400) if lo <= p <= hi and deck == "ab"[p % 2]}
    rows = [(r.id, r.page_no) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_boilerplate_is_counted_by_hashes_first(spark):
    """No exchange carries a line before its hash is known to be frequent; repeated lines of a page count once."""
    rows = [("d", i, f"Head\nline {i}\nline {i}" + ("\nx\nfoot" if i < 3 else "")) for i in range(5)] + [("e", 0, None), ("e", 1, "Head")]
    pages = spark.createDataFrame(rows, "deck string, page_no int, text string")
    got = {(r.deck, r.key, r.n) for r in cleanup.boilerplate_keys(pages, 0.5).collect()}
    assert got == {("d", "head", 5), ("d", "foot", 3)}
    early = cleanup.strip_boilerplate(pages.where("page_no < 2"), common=cleanup.boilerplate_keys(pages, 0.5))
    assert {(r.deck, r.page_no, r.text) for r in early.collect()} == {("d", 0, "line 0\nline 0\nx"), ("d", 1, "line 1\nline 1\nx"), ("e", 0, ""), ("e", 1, "Head")}


def test_tokens_are_counted_in_their_row(spark):
    """Rows that share an id, or have none, count together; without such rows nothing but ids is shuffled."""
    docs = spark.createDataFrame([(1, "bbb aaa bbb"), (1, "aaa ccc"), (None, "aaa"), (None, "aaa"), (2, None), (3, "no"), (4, "ddd")], "doc_id long, text string")
    got = {(r.doc_id, r.token, r.tf) for r in search.term_counts(docs, ["doc_id"]).collect()}
    assert got == {(1, "aaa", 2), (1, "bbb", 2), (1, "ccc", 1), (None, "aaa", 2), (4, "ddd", 1)}
    plan = search.term_counts(docs.where("doc_id > 1"), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_phrases_are_found_inside_rows_as_by_an_index(spark, monkeypatch):
    texts = ["the cat sat on the mat", "The Cat sat the cat sat", "mat", None, "", "cat the sat", "the the cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    phrases = spark.createDataFrame([(1, "the cat"), (2, "cat sat"), (3, "absent cat"), (4, ""), (5, None), (6, "the the")], "query_id int, text string")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "place").collect()))
    want = rows(search.phrase_hits(search.build_postings(docs), phrases))
    hits, sizes = search.text_hits(docs, phrases)
    assert rows(hits) == want and want and sizes.agg(F.sum("dl")).first()[0] == 19
    monkeypatch.setattr(search, "WORDS_AT_ONCE", 1)
    assert rows(search.text_hits(docs, phrases)[0]) == want


def test_weights_of_rare_tokens_are_those_of_frequent_ones(spark, monkeypatch):
    docs = spark.createDataFrame([(0, i, " ".join(f"tok{j}" for j in range(i, i + 5))) for i in range(20)], "project_id long, doc_id long, text string")
    queries = spark.createDataFrame([(0, 1, "tok3 tok9 tok9"), (0, 2, "tok0 none")], "project_id long, query_id long, text string")
    rows = lambda: sorted(map(tuple, search.tfidf_rank(queries, docs).collect()))
    whole = rows()
    monkeypatch.setattr(search, "HEAD", 2)
    assert rows() == whole and len(whole) > 5
