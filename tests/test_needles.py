"""The automaton against one pattern after the other, and hits across segments against the joined text."""

import random

import pytest
from pyspark.sql import functions as F

from lectorium.functions.text import normalize_match
from lectorium.operators import edits, needles

SEGMENTS, RULES = "project_id long, transcript_id long, idx long, text string", "project_id long, rule_id long, find string"
WORDS = ["a", "the", "of the", "it's", "it’s", "x-ray", "x—ray", "x − ray", "«so»", '"so"', "5′", "5'", "naïve", "été", "(b)", "a.b", "$1", "aa aa"]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", "  ", " ", "\n", ", ", "", "  "]) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_pass_finds_what_each_pattern_finds(spark, seed):
    rng = random.Random(seed)
    segments = [(i % 2, i // 5, i % 5, text(rng, rng.randrange(12))) for i in range(60)] + [(0, 90, 0, None), (0, 90, 1, ""), (None, 91, 0, "the the")]
    finds = [text(rng, k).strip() for k in (1, 1, 1, 2, 2, 3) for _ in range(6)] + ["", "  ", None, "the", "the"]
    rules = [(i % 3, i, f) for i, f in enumerate(finds)]
    seg, rul = spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(rules, RULES)
    columns = ["rule_id", "transcript_id", "idx", "start", "end"]
    got = rows_of(edits.find_occurrences(seg, rul).select(*columns))
    assert got == rows_of(edits.occurrences_by_pattern(seg, rul).select(*columns)) and len(got) > 50
    few = needles.find_needles(seg, rul, "project_id", "rule_id", most=30)  # rules in several rounds
    assert rows_of(few.select(*columns)) == got


@pytest.mark.parametrize("sign,plain", [("−", "-"), ("«", '"'), ("»", '"'), ("′", "'"), ("´", "'"), ("`", "'"), ("’", "'"), ("“", '"'), ("–", "-"), ("‑", "-")])
def test_signs_count_as_plain_ones(spark, sign, plain):
    seg = spark.createDataFrame([(1, 1, 0, f"see a{sign}b now")], SEGMENTS)
    for find in (f"a{plain}b", f"a{sign}b"):
        rul = spark.createDataFrame([(1, 1, find)], RULES)
        for op in (edits.find_occurrences, edits.occurrences_by_pattern):
            assert [(r.start, r.end) for r in op(seg, rul).collect()] == [(4, 7)]
    assert spark.range(1).select(normalize_match(F.lit(f" x{sign}  y ")).alias("n")).first().n == f"x{plain} y"


def test_signs_that_are_no_variants_stay(spark):
    assert spark.range(1).select(normalize_match(F.lit("‚a„ ‛b‟")).alias("n")).first().n == "‚a„ ‛b‟"


def test_ten_thousand_rules_in_one_pass(spark):
    seg = spark.createDataFrame([(1, i, 0, " ".join(f"w{(i * 37 + j) % 12000}" for j in range(50))) for i in range(100)], SEGMENTS)
    rul = spark.range(10_000).selectExpr("1L as project_id", "id as rule_id", "concat('w', id) as find")
    want = sum((i * 37 + j) % 12000 < 10_000 for i in range(100) for j in range(50))
    found = edits.find_occurrences(seg, rul)
    assert found.count() == want
    assert found._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def joined_hits(segments, finds, spark):
    """Every place in the joined text, by trying them all."""
    norm = {}
    for t, i, x in segments:
        norm.setdefault(t, []).append((i, " ".join((x or "").split())))
    out = []
    for t, rows in norm.items():
        spans, text = [], ""
        for i, x in sorted(rows):
            if x:
                text += " " if text else ""
                spans.append((len(text), len(text) + len(x), i))
                text += x
        for n, f in finds:
            f = " ".join(f.split())
            for a in range(len(text) - len(f) + 1):
                b = a + len(f)
                if f and text[a:b] == f and not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()):
                    first, last = next(s for s in spans if s[0] <= a < s[1]), next(s for s in spans if s[0] < b <= s[1])
                    out.append((n, t, first[2], a - first[0], last[2], b - last[0]))
    return sorted(out)


@pytest.mark.parametrize("stretch", [1 << 16, 16, 5])
def test_hits_across_segments_have_both_ends(spark, stretch):
    """Also where a needle spans several short segments, and stretches are shorter than it."""
    rng = random.Random(stretch)
    segments = [(t, i, " ".join(rng.choice(["ab", "a", "ba", "abab", " "]) for _ in range(rng.randrange(5)))) for t in range(3) for i in range(40)]
    segments += [(9, 0, None), (9, 1, ""), (9, 2, "a"), (8, 5, "a  a a a")]
    finds = [(1, "ab a"), (2, "a"), (3, "ba ab ab ba"), (4, "a a"), (5, ""), (6, "zz"), (7, "a ba  a")]
    got = needles.locate_needles(spark.createDataFrame(segments, "transcript_id long, idx long, text string"), spark.createDataFrame(finds, "needle_id long, find string"), stretch)
    want = joined_hits(segments, finds, spark)
    assert sorted(map(tuple, got.collect())) == want and any(r[2] != r[4] for r in want)


def test_empty_tables(spark):
    seg, fin = spark.createDataFrame([(1, 0, "a")], "transcript_id long, idx long, text string"), spark.createDataFrame([(1, "a")], "needle_id long, find string")
    assert needles.locate_needles(seg.limit(0), fin).collect() == [] and needles.locate_needles(seg, fin.limit(0)).collect() == []
