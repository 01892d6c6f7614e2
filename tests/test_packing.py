"""Packs of sequences in many small blocks against going through them."""

import random

import pytest
from pyspark.sql import functions as F

from lectorium.operators.packing import pack
from lectorium.operators.search import transcript_windows


def walked(sizes, need):
    out, held, n = [], 0.0, 0
    for x in sizes:
        held += x
        out.append(n)
        if held >= need:
            held, n = 0.0, n + 1
    return out


@pytest.mark.parametrize("block", [1, 2, 5, 4096])
def test_packs_equal_the_walk(spark, block):
    """Blocks of one item, packs that span several blocks, items larger than a pack, zeros, nulls, a null key, gaps in the order."""
    rng = random.Random(block)
    sequences = {1: [rng.choice([0, 1, 2, 7, 30]) for _ in range(60)], 2: [1] * 40, 3: [0] * 9, 4: [50], 5: [], None: [rng.choice([3, 9]) for _ in range(23)], 6: [25] * 11}
    rows = [(k, 3 * i + 1, x if x else None) for k, xs in sequences.items() for i, x in enumerate(xs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, place long, size long")
    for need in (1, 10, 25):
        got = {}
        for r in pack(df, "k", "place", F.col("size"), need, block=block).orderBy("place").collect():
            got.setdefault(r.k, []).append(r.pack)
        assert got == {k: walked(xs, need) for k, xs in sequences.items() if xs}


def test_totals_that_stand_still_or_fall(spark):
    """The largest so far counts; a null changes nothing."""
    totals = [3.0, None, 2.0, 12.0, 11.0, 12.0, 23.0, 40.0]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(totals)], "k long, place long, t double")
    for block in (2, 4096):
        got = [r.pack for r in pack(df, "k", "place", None, 10.0, total="t", block=block).orderBy("place").collect()]
        assert got == [0, 0, 0, 0, 1, 1, 1, 2]


def test_windows_of_odd_segments(spark):
    rows = [(1, 1, 0, None, None), (1, 1, 1, 5.0, "abc"), (1, 1, 2, 6.0, "defgh"), (1, 1, 3, 7.0, "  "), (1, 2, 0, 1.0, "")]
    got = transcript_windows(spark.createDataFrame(rows, "project_id long, transcript_id long, idx long, start_s double, text string"), 8)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0, 5.0, "abc defgh")]
