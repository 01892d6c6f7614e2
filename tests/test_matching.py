"""Tiled matching against all pairs, and the whole job."""

import random

import numpy as np
import pytest

from lectorium.operators import matching as m

PAGES, LECTURES = "project_id long, deck long, page_no long, vec array<double>", "project_id long, transcript_id long, vec array<double>"


def vectors(rng, n):
    return [[rng.gauss(0, 1) for _ in range(6)] for _ in range(n)]


def brute(pages, lectures, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    out = []
    for c, d, p, v in pages:
        if c is None or v is None or not any(v):
            continue
        scored = sorted((-round(float(unit(v) @ unit(w)), 9), t) for e, t, w in lectures if e == c and w is not None and any(w))
        out += [(c, d, p, t, -s, n + 1) for n, (s, t) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,tile", [(2048, 2048), (7, 3), (1, 1)])
def test_tiles_give_the_best_of_all_pairs(spark, block, tile):
    """Courses of different size, one without lectures, one without pages, null, zero and repeated vectors."""
    rng = random.Random(block)
    lectures = [(i % 3, i, v) for i, v in enumerate(vectors(rng, 20))]
    lectures += [(0, 100, lectures[0][2]), (0, 101, None), (0, 102, [0.0] * 6), (7, 103, [1.0] * 6)]
    pages = [(i % 4, i // 5, i % 5, v) for i, v in enumerate(vectors(rng, 40))]
    pages += [(0, 90, 0, lectures[0][2]), (0, 90, 1, None), (0, 90, 2, [0.0] * 6), (None, 91, 0, [1.0] * 6)]
    found = m.top_lectures(spark.createDataFrame(pages, PAGES), spark.createDataFrame(lectures, LECTURES), 3, block, tile)
    got = sorted((r.project_id, r.deck, r.page_no, r.transcript_id, round(r.score, 9), r["rank"]) for r in found.collect())
    assert got == brute(pages, lectures, 3)


@pytest.mark.parametrize("pages_kind,lectures_kind", [("long", "int"), ("int", "long")])
def test_courses_of_different_types_meet(spark, pages_kind, lectures_kind):
    """With several partitions a page finds the lectures of its course also if one side's number is an int, the other's a long."""
    rng = random.Random(1)
    lectures, pages = [(i % 5, i, v) for i, v in enumerate(vectors(rng, 30))], [(i % 5, i // 5, i % 5, v) for i, v in enumerate(vectors(rng, 60))]
    p = spark.createDataFrame(pages, PAGES.replace("project_id long", f"project_id {pages_kind}"))
    l = spark.createDataFrame(lectures, LECTURES.replace("project_id long", f"project_id {lectures_kind}"))  # noqa: E741
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = m.top_lectures(p, l, 3, 4, 3)
        got = sorted((r.project_id, r.deck, r.page_no, r.transcript_id, round(r.score, 9), r["rank"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(pages, lectures, 3) and found.schema["project_id"].dataType.simpleString().replace("bigint", "long") == pages_kind


def test_empty_tables(spark):
    pages, lectures = spark.createDataFrame([(0, 0, 0, [1.0])], PAGES), spark.createDataFrame([(0, 0, [1.0])], LECTURES)
    assert m.top_lectures(pages.limit(0), lectures, 2).collect() == [] and m.top_lectures(pages, lectures.limit(0), 2).collect() == []
    assert m.match_pages(pages, lectures.limit(0)).collect() == []


def test_the_job_leaves_exams_and_confirmed_links(spark):
    """Deck 1 is an exam; of deck 0 pages 0-3 belong to lecture 5, 4-7 to 6; page 2's vector is old, so its neighbours place it."""
    a, b = [1.0, 0.0], [0.0, 1.0]
    given = "project_id long, deck long, page_no long, ref_id long, source_sha string, vec array<double>"
    sha = lambda t: spark.sql("select substring(sha2(:t, 256), 1, 16)", args={"t": t}).first()[0]
    texts = {i: f"text of page {i} that is long enough to have a vector" for i in range(16)}
    pages = [(0, i // 8, i % 8, i, sha("old" if i == 2 else texts[i]), b if i % 8 > 3 or i == 2 else a) for i in range(16)]
    lectures = spark.createDataFrame([(0, 5, a), (0, 6, b)], LECTURES)
    decks = spark.createDataFrame([(0, "slides"), (1, "exam")], "deck long, kind string")
    link = "deck long, page_from long, page_to long, transcript_id long, score double, link_source string"
    current = spark.createDataFrame([(0, 4, 7, 9, 1.0, "manual"), (0, 0, 1, 9, 0.1, "auto"), (1, 0, 7, 9, 0.1, "auto")], link)
    run = lambda texts: sorted(tuple(r)[:4] + (r.link_source,) for r in m.match_project(spark.createDataFrame(pages, given), lectures, spark.createDataFrame(list(texts.items()), "ref_id long, text string"), decks, current).collect())
    assert run(texts) == [(0, 0, 3, 5, "auto"), (0, 4, 7, 9, "manual"), (1, 0, 7, 9, "auto")]
    assert run({}) != run(texts)  # without texts nothing is known to be old, and the wrong vector counts
