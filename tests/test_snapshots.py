"""Stored tables: one switch per change, untouched buckets keep their files, failures and repeats change nothing."""

import os

import pytest
from pyspark.sql import functions as F

from lectorium.operators import upkeep
from lectorium.sources.snapshots import BucketTable, Conflict

TERMS = "k long, v string, note string, at long"


def terms(spark, rows):
    return spark.createDataFrame(rows, TERMS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "terms"), TERMS, ["k"], buckets=8)
    upkeep.write_upserts(t, terms(spark, [(i, f"v{i}", "n", 1) for i in range(40)]), ["k"], "at", ["note"])
    return t


def test_upserts_equal_the_batch_operator(spark, table):
    before = table.read()
    changes = terms(spark, [(3, "new", None, 2), (99, "first", "x", 2), (None, "null key", None, 1)])
    want = rows_of(upkeep.upsert_keyed(before, changes, ["k"], "at", ["note"]))
    upkeep.write_upserts(table, changes, ["k"], "at", ["note"])
    assert rows_of(table.read()) == want
    assert (3, "new", "n", 2) in want  # the note that a change leaves out stays


def test_untouched_buckets_keep_their_files(spark, table):
    before = table.snapshots.last()
    upkeep.write_upserts(table, terms(spark, [(3, "new", None, 2)]), ["k"], "at")
    after = table.snapshots.last()
    changed = {b for b in after.parts if after.parts[b] != before.parts.get(b)}
    assert changed == {str(b) for b in table.touched(terms(spark, [(3, "", "", 0)]))} and len(after.parts) == len(before.parts)


def test_a_reader_keeps_what_it_began_with(spark, table):
    old = table.read()
    table.change(old, lambda current: current.withColumn("v", F.lit("all new")))
    assert "all new" not in {r.v for r in old.collect()}
    assert {r.v for r in table.read().collect()} == {"all new"}
    assert rows_of(table.read(version=1)) == rows_of(old)


def test_a_failed_change_leaves_the_table(spark, table):
    want, version = rows_of(table.read()), table.snapshots.last().version
    broken = F.when(F.col("k") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("v"))
    with pytest.raises(Exception, match="broken"):
        table.change(table.read(), lambda current: current.withColumn("v", broken))
    assert rows_of(table.read()) == want and table.snapshots.last().version == version


def test_rows_of_other_buckets_are_refused(spark, table):
    one = terms(spark, [(3, "", "", 0)])
    with pytest.raises(ValueError, match="made rows of buckets"):
        table.change(one, lambda current: current.union(terms(spark, [(i, "x", "x", 1) for i in range(40)])))


def test_a_tag_is_applied_once(spark, table):
    add = lambda current: current.union(terms(spark, [(3, "again", "x", 5)]))
    one = terms(spark, [(3, "", "", 0)])
    assert table.change(one, add, ("stream", 4)) and not table.change(one, add, ("stream", 4)) and not table.change(one, add, ("stream", 2))
    assert [r.v for r in table.read().where("k = 3").collect()].count("again") == 1


def test_the_slower_of_two_writers_fails(spark, table):
    def step(current):
        upkeep.write_upserts(BucketTable(spark, table.snapshots.folder, TERMS, ["k"], 8), terms(spark, [(5, "faster", None, 9)]), ["k"], "at")
        return current.withColumn("v", F.lit("slower"))

    with pytest.raises(Conflict):
        table.change(terms(spark, [(3, "", "", 0)]), step)
    got = {r.k: r.v for r in table.read().collect()}
    assert got[5] == "faster" and got[3] == "v3"


def test_emptied_buckets_and_cleaning(spark, table):
    upkeep.write_upserts(table, terms(spark, [(3, "new", None, 2)]), ["k"], "at")
    table.change(table.read(), lambda current: current.where("k = 5"))
    assert [r.k for r in table.read().collect()] == [5]
    table.snapshots.clean(keep=1)
    assert len(os.listdir(f"{table.snapshots.folder}/data")) == 1 and [r.k for r in table.read().collect()] == [5]
    assert table.snapshots.last().version == 3


def test_an_empty_table_and_an_empty_change(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "none"), TERMS, ["k"])
    assert t.read().collect() == []
    t.change(terms(spark, []), lambda current: current)
    assert t.read().collect() == [] and t.snapshots.last().version == 1


def test_links_and_cards_equal_the_batch_operators(spark, tmp_path):
    link = "deck string, page_from long, page_to long, transcript_id long, score double, link_source string"
    links = spark.createDataFrame([("a", 1, 3, 7, 0.5, "manual"), ("a", 4, 6, 8, 0.6, "auto"), ("b", 1, 2, 9, 0.7, "auto")], link)
    fresh = spark.createDataFrame([("a", 1, 3, 1, 0.9, "auto"), ("a", 4, 9, 2, 0.8, "auto"), ("b", 1, 9, 3, 0.9, "auto")], link)
    decks = spark.createDataFrame([("a",)], "deck string")
    t = BucketTable(spark, str(tmp_path / "links"), link, ["deck"])
    t.change(links, lambda current: links)
    upkeep.write_auto_links(t, fresh, decks)
    assert rows_of(t.read()) == rows_of(upkeep.refresh_auto_links(links, fresh, decks))
    card = "transcript_id long, front string, edited boolean"
    cards = spark.createDataFrame([(1, "old", False), (1, "mine", True), (2, "kept", False)], card)
    new = spark.createDataFrame([(1, "new", False)], card)
    t = BucketTable(spark, str(tmp_path / "cards"), card, ["transcript_id"])
    t.change(cards, lambda current: cards)
    upkeep.write_generated_cards(t, new)
    assert rows_of(t.read()) == rows_of(upkeep.replace_generated_cards(cards, new))
