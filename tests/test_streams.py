"""Streams that stop and go on: each test lays files down in turn and runs the stream over what is there."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectorium.operators import matching
from lectorium.operators.search import build_postings
from lectorium.streaming import streams as s

EVENTS = "event_id long, user_id long, ts timestamp, event_type string, value double"
START = datetime(2024, 1, 1)


def lay(spark, path, rows, schema):
    """One more file of a folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_latest_keeps_the_last_batch_of_every_group(spark, tmp_path):
    """Six files make two batches; job 1 changes in both, job 2 in the first only, a null job stays a group."""
    path = str(tmp_path / "events.parquet")
    for i in range(6):
        job = 1 if i in (0, 5) else 2 if i == 1 else None
        lay(spark, path, [(i, job, START + timedelta(hours=i), f"status {i}", float(i))], EVENTS)
    board = s.latest(s.stream_job_board(s.arriving(spark, path)), "board", ["job_id"])
    assert {(r.job_id, r.status, r.n) for r in board.collect()} == {(1, "status 5", 2), (2, "status 1", 1), (None, "status 4", 3)}
    progress = s.latest(s.stream_progress(s.arriving(spark, path), 10.0), "progress", ["job_id"])
    want = {(1, 5.0, 2, 0.5, round(5 / 18000, 6), round(5 / (5 / 18000), 1)), (2, 1.0, 1, 0.1, 1000.0, 0.0), (None, 9.0, 3, 0.9, round(9 / 7200, 6), round(1 / (9 / 7200), 1))}
    assert {(r.job_id, r.position, r.n_segments, r.progress, r.speed, r.eta) for r in progress.collect()} == want


def test_a_stopped_stream_goes_on(spark, tmp_path):
    """Two files, then two more: the second run reads only those, knows the first ones' keys, and counts the late row."""
    path, folder = str(tmp_path / "events.parquet"), str(tmp_path / "run")
    at = lambda h: START + timedelta(hours=h)
    files = [
        [(0, 1, at(0), "a", 1.0), (1, 1, at(1), "a", 1.0), (1, 1, at(1), "a", 1.0)],
        [(2, 1, at(1), "a", 1.0), (3, 1, at(4), "b", 2.0)],  # a segment that the resumed writer repeats
        [(4, 1, at(4), "b", 2.0), (5, 2, at(5), "b", 2.0)],
        [(6, 1, at(0), "late", 9.0), (7, 2, at(30), "c", 3.0)],
    ]
    stream = lambda: s.stream_segments(s.arriving(spark, path, files=1), "2 hours").select("user_id", "event_type", "value")
    runs = []
    for pair in (files[:2], files[2:]):
        for rows in pair:
            lay(spark, path, rows, EVENTS)
        runs.append(s.append(stream(), folder))
    assert [r.rows_read for r in runs] == [5, 4] and [r.rows_late for r in runs] == [0, 1]
    assert s.append(stream(), folder).rows_read == 0
    got = rows_of(spark.read.parquet(f"{folder}/rows"))
    assert got == [(1, "a", 1.0), (1, "a", 1.0), (1, "b", 2.0), (2, "b", 2.0), (2, "c", 3.0)]


SEGMENTS = "transcript_id long, idx long, seconds double, last boolean, ts timestamp"


def chunked(seconds, every):
    """The close moves to the end of the segment that reaches it."""
    out, media, closed, chunk = [], 0.0, 0.0, 0
    for i, x in enumerate(seconds):
        media += x
        out.append((i, chunk))
        if media - closed >= every:
            closed, chunk = media, chunk + 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_chunks_of_any_split_of_files_equal_the_fold(spark, tmp_path, seed):
    """Segments come shuffled over four files in two runs, some twice, also after the last."""
    rng, path, folder = random.Random(seed), str(tmp_path / "segments.parquet"), str(tmp_path / "run")
    lectures = {t: [rng.choice([0.0, 3.5, 7.0, 40.0]) for _ in range(n)] for t, n in ((1, 30), (2, 1), (3, 12))}
    rows = [(t, i, x, i == len(xs) - 1, START + timedelta(seconds=i)) for t, xs in lectures.items() for i, x in enumerate(xs)]
    rows += rng.sample(rows, 8)
    rng.shuffle(rows)
    for run in (0, 1):
        for k in (0, 1):
            lay(spark, path, rows[2 * run + k :: 4], SEGMENTS)
        s.append(s.stream_flush_windows(s.arriving(spark, path, files=1).drop("ts"), 20.0), folder)
    got = rows_of(spark.read.parquet(f"{folder}/rows").select("transcript_id", "idx", "chunk"))
    assert got == sorted(((t, i, c) for t, xs in lectures.items() for i, c in chunked(xs, 20.0)), key=repr)
    table = spark.createDataFrame([(t, i, sum(xs[: i + 1])) for t, xs in lectures.items() for i in range(len(xs))], "transcript_id long, idx long, end_s double")
    assert got == rows_of(s.flush_chunks(table, 20.0))


def test_an_idle_job_gives_out_what_waits_and_ends(spark, tmp_path):
    """Segment 1 of lecture 1 never comes; when time has gone on by an hour, segments 2 and 3 are given out and the job ends.

    Lecture 3 ends with its last segment, which comes twice. The state of both is gone.
    """
    path, folder = str(tmp_path / "segments.parquet"), str(tmp_path / "run")
    at = lambda m: START + timedelta(minutes=m)
    lay(spark, path, [(1, 0, 15.0, False, at(0)), (1, 3, 9.0, False, at(1)), (1, 2, 9.0, False, at(1)), (3, 0, 1.0, True, at(1))], SEGMENTS)
    lay(spark, path, [(3, 0, 1.0, True, at(1))], SEGMENTS)
    stream = lambda: s.stream_flush_windows(s.arriving(spark, path, files=1), 20.0, "1 minute", 3600.0)
    s.append(stream(), folder)
    read = lambda: rows_of(spark.read.parquet(f"{folder}/rows").where("transcript_id = 1").select("idx", "chunk"))
    assert read() == [(0, 0)]
    for m in (300, 600):
        lay(spark, path, [(2, m, 1.0, False, at(m))], SEGMENTS)
    s.append(stream(), folder)
    assert read() == [(0, 0), (2, 0), (3, 1)]
    assert spark.read.parquet(f"{folder}/rows").where("transcript_id = 3").count() == 1
    of = {r.operatorName: r.operatorId for r in spark.read.format("state-metadata").load(f"{folder}/state").collect()}
    chunker = next(n for name, n in of.items() if name.startswith("transformWithState"))
    place = spark.read.format("statestore").option("operatorId", chunker).option("stateVarName", "place").load(f"{folder}/state")
    assert [r.key.transcript_id for r in place.collect()] == [2]


DOCS = "doc_id long, text string, deleted boolean"


def test_the_index_follows_changes_and_deletes(spark, tmp_path):
    path, folder = str(tmp_path / "docs.parquet"), str(tmp_path / "run")
    files = [
        [(1, "old words here", False), (2, "kept words", False), (None, "no id", False)],
        [(1, "", False), (3, "three", None)],
        [(2, "new", False), (3, None, True), (4, "four", False), (4, "times four", False)],
        [(None, "id none", False), (9, "gone", True)],
    ]
    now = {}
    for rows in files:
        lay(spark, path, rows, DOCS)
        index = s.stream_index_upkeep(s.arriving(spark, path), folder=folder, fan=3)  # goes on in the same folder
        for i in {r[0] for r in rows}:
            now[i] = [t for k, t, gone in rows if k == i and not gone]
        want = rows_of(build_postings(spark.createDataFrame([(i, t) for i, ts in now.items() for t in ts], "doc_id long, text string")).select("doc_id", "pos", "token"))
        assert rows_of(index) == want
    assert not {r.doc_id for r in index.collect()} & {1, 3, 9}


def test_segments_of_the_index_stay_few(spark, tmp_path):
    """Thirty batches, each of one document that replaces, empties or adds one; a batch that comes again changes nothing."""
    index, rng, now = s.PostingsIndex(spark, str(tmp_path / "index"), fan=3), random.Random(5), {}
    for n in range(30):
        i, text = rng.randrange(6), rng.choice(["", "a b", "b c d", f"only {n}"])
        batch = spark.createDataFrame([(i, text)], "doc_id long, text string")
        index.add(batch, n)
        index.add(batch.withColumn("text", F.lit("again")), n)
        now[i] = text
        assert len(index.snapshots.last().parts) <= 2 * 4  # fewer than three for each digit of 30 to the base 3
    want = build_postings(spark.createDataFrame(list(now.items()), "doc_id long, text string"))
    assert rows_of(index.postings()) == rows_of(want.select("doc_id", "pos", "token"))
    index.snapshots.clean(keep=1)
    assert rows_of(index.postings()) == rows_of(want.select("doc_id", "pos", "token"))
    ids = index._read(list(index.snapshots.last().parts.values()))[0]
    assert ids.count() < 30  # merged segments have dropped what was replaced


CHANGES = "kind string, project_id long, deck long, page_no long, transcript_id long, vec array<double>, source_sha string"


def vectors(rng, course):
    """Four lectures and two decks of nine pages near to them."""
    lectures = {10 * course + i: [rng.gauss(0, 1) for _ in range(8)] for i in range(4)}
    pages = {(2 * course + d, p): [x + 0.3 * rng.gauss(0, 1) for x in lectures[10 * course + (p // 3 + d) % 4]] for d in range(2) for p in range(9)}
    change = [("lecture", course, None, None, t, v, f"l{t}") for t, v in lectures.items()]
    return change + [("page", course, d, p, None, v, f"p{d}-{p}") for (d, p), v in pages.items()]


def test_links_follow_the_vectors_and_only_touched_courses_are_matched(spark, tmp_path):
    rng, path, folder = random.Random(8), str(tmp_path / "changes.parquet"), str(tmp_path / "run")
    made, stored = [], {}

    def store(folder):
        made.append(s.MatchedCourses(spark, f"{folder}/courses", 0.6, 0.02, buckets=16))
        return made[-1]

    first = vectors(rng, 1) + vectors(rng, 2)
    swapped = [r[:5] + ([rng.gauss(0, 1) for _ in range(8)], "new") for r in first if r[0] == "lecture" and r[1] == 2]
    gone = [r[:5] + (None, None) for r in first if r[0] == "page" and r[2] == 5]
    for n, rows in enumerate((first, first[:5], swapped, gone + first[:3])):
        lay(spark, path, rows, CHANGES)
        before = made[-1].links.snapshots.last() if made else None
        links = s.stream_restale(s.arriving(spark, path), store, folder=folder)
        stored |= {r[:5]: r for r in rows}
        live = spark.createDataFrame([r for r in stored.values() if r[5] is not None], CHANGES)
        pages, lectures = live.where("kind = 'page'").select("project_id", "deck", "page_no", "vec"), live.where("kind = 'lecture'").select("project_id", "transcript_id", "vec")
        want = matching.match_pages(pages, lectures, 0.6, 0.02)
        columns = ["deck", "page_from", "page_to", "transcript_id", "score"]
        assert rows_of(links.select(*columns)) == rows_of(want.select(*columns)) and links.count() > 0
        if before is not None:
            after = made[-1].links.snapshots.last()
            changed = {b for b in after.parts if after.parts[b] != before.parts.get(b)}
            course = spark.createDataFrame([(2,)], "project_id long")
            assert changed == (set() if n == 1 else {str(b) for b in made[-1].links.touched(course)})  # equal content touches nothing


def test_a_batch_that_failed_half_way_ends_alike(spark, tmp_path, monkeypatch):
    """The vectors are stored, the links are not: the second try still knows which courses to match."""
    rows = vectors(random.Random(9), 1)
    df = spark.createDataFrame(rows, CHANGES)
    pages, lectures = df.where("kind = 'page'"), df.where("kind = 'lecture'")
    courses = s.MatchedCourses(spark, str(tmp_path / "courses"))
    monkeypatch.setattr(s.MatchedCourses, "_matched", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        courses.apply(pages, lectures, 0)
    monkeypatch.undo()
    assert courses.links.read().count() == 0
    for _ in range(2):
        courses.apply(pages, lectures, 0)
        want = matching.match_pages(pages.select("project_id", "deck", "page_no", "vec"), lectures.select("project_id", "transcript_id", "vec"))
        assert rows_of(courses.links.read().select("deck", "page_from", "page_to", "transcript_id")) == rows_of(want.select("deck", "page_from", "page_to", "transcript_id"))


def links_and_match(spark, links, rows):
    """Links of a stream of changes, and those of all that the last row of each page and lecture says."""
    live = spark.createDataFrame([r for r in {r[:5]: r for r in rows}.values() if r[5] is not None], CHANGES)
    pages, lectures = live.where("kind = 'page'").select("project_id", "deck", "page_no", "vec"), live.where("kind = 'lecture'").select("project_id", "transcript_id", "vec")
    columns = ["deck", "page_from", "page_to", "transcript_id", "score"]
    return rows_of(links.select(*columns)), rows_of(matching.match_pages(pages, lectures, 0.6, 0.02).select(*columns))


def test_a_run_of_many_batches_matches_once(spark, tmp_path, monkeypatch):
    """Six batches of one file; pages come again with other vectors, are taken away, and come back."""
    rng, path, folder = random.Random(10), str(tmp_path / "changes.parquet"), str(tmp_path / "run")
    first = vectors(rng, 1) + vectors(rng, 2)
    moved = [r[:5] + ([rng.gauss(0, 1) for _ in range(8)], "moved") for r in first if r[0] == "page" and r[2] == 4]
    gone = [r[:5] + (None, None) for r in first if r[0] == "page" and r[2] in (2, 5)]
    back = [r for r in first if r[0] == "page" and r[2] == 5][:4]
    files, matched = [first[:20], first[20:], moved, gone, back, moved[:3]], []
    for rows in files:
        lay(spark, path, rows, CHANGES)
    monkeypatch.setattr(s, "match_pages", lambda *a: matched.append(1) or matching.match_pages(*a))
    store = lambda folder: s.MatchedCourses(spark, f"{folder}/courses", buckets=16)

    def run():
        return s.stream_restale(s.arriving(spark, path, files=1), store, folder=folder)

    got, want = links_and_match(spark, run(), sum(files, []))
    assert got == want and got
    assert len(matched) == 1
    lay(spark, path, moved[:2], CHANGES)  # nothing new
    assert links_and_match(spark, run(), sum(files, []))[0] == want
    names = s.Snapshots(spark, f"{folder}/courses/steps").names
    assert names("kept-vectors") == [] and names("taken-vectors") == []  # what has been applied is not held twice


def test_content_is_looked_up_once_a_run(spark, tmp_path):
    """The stream names rows by an id of its own; their vectors come from a table."""
    rows, path, asked = vectors(random.Random(11), 1), str(tmp_path / "ids.parquet"), []
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id long, {CHANGES}")
    for n in range(3):
        lay(spark, path, [(i,) for i in range(n, len(rows), 3)], "id long")

    def content(named):
        asked.append(1)
        return named.join(table, "id").drop("id")

    store = lambda folder: s.MatchedCourses(spark, f"{folder}/courses", buckets=4)
    links = s.stream_restale(s.arriving(spark, path, files=1), store, folder=str(tmp_path / "run"), content=content)
    got, want = links_and_match(spark, links, rows)
    assert got == want and got and len(asked) == 1


def test_a_run_that_failed_half_way_is_ended_before_later_batches(spark, tmp_path, monkeypatch):
    """The vectors of the first run are stored, its links are not; the next run has a batch of another course."""
    rng, path, folder = random.Random(12), str(tmp_path / "changes.parquet"), str(tmp_path / "run")
    files = [vectors(rng, 1), vectors(rng, 2)]
    store = lambda folder: s.MatchedCourses(spark, f"{folder}/courses", buckets=16)
    run = lambda: s.stream_restale(s.arriving(spark, path, files=1), store, folder=folder)
    lay(spark, path, files[0], CHANGES)
    monkeypatch.setattr(s.MatchedCourses, "_matched", lambda *_: 1 / 0)
    with pytest.raises(Exception, match="division by zero"):
        run()
    monkeypatch.undo()
    lay(spark, path, files[1], CHANGES)
    got, want = links_and_match(spark, run(), sum(files, []))
    assert got == want and {r[0] for r in got} == {2, 3, 4, 5}
