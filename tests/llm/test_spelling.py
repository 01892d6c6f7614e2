import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectorium.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    c = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 97 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            c[r] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def formed(n):
    """All pairs of words."""
    others = {w: [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)] for w in n}
    best = {w: min(o, key=lambda x: (-n[x], x), default=None) for w, o in others.items()}
    form = {w: b if b and n[b] >= 2 * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], form[w], n.get(form[w]), root, len(others[w])))
    return sorted(out)


def found(df):
    return sorted((r.word, r.n, r.form, r.form_n, r.root, r.n_near) for r in df.collect())


def crowd(seed, n=300):
    """Words around a few stems, many with equal halves, of 5 to 9 letters."""
    rng = random.Random(seed)
    stems = ["inter", "abcab", "ééçab", "aaaaa", "interest", "abcdefgh"]
    out = set()
    while len(out) < n:
        w = list(rng.choice(stems))
        for _ in range(rng.randrange(3)):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w[at : at + (kind > 0)] = [rng.choice("abcé")] if kind < 2 else []
        if len(w) >= 5:
            out.add("".join(w))
    return sorted(out)


@pytest.mark.parametrize("group", [spelling.GROUP, 7])
def test_near_words_equal_all_pairs(spark, group):
    """Also when groups are dealt out in tiles."""
    words = crowd(group)
    n = {w: 3 + (7 * i) % 40 for i, w in enumerate(words)}
    got = {r.word: (r.n_near, r.best, r.best_n) for r in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), group).collect()}
    others = {w: [x for x in words if near(w, x)] for w in words}
    assert got == {w: (len(o), b := min(o, key=lambda x: (-n[x], x)), n[b]) for w, o in others.items() if o}


def test_walks_find_each_pair_on_one_side():
    words = np.array(["abcdef", "abcxef", "xbcdef", "abcdeg"])
    slices = spelling.Slices(words, 6)
    for query, wanted in [("abcdef", {1, 2, 3}), ("abcdf", {0}), ("abcdeff", {0}), ("abcdefg", {0, 3}), ("bcdef", {0, 2}), ("zabcdef", {0}), ("qqqqqq", set())]:
        sides = [set(slices.near(np.array([query]), len(query), side)[1].tolist()) for side in (True, False)]
        assert sides[0] | sides[1] == wanted and not sides[0] & sides[1], query


def test_variants_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from lectorium.llm.queries import QUERIES

    assert found(QUERIES["op13_spelling_variants"](spark, sf)) == formed(counted([(r.doc_id, r.text) for r in docs.collect()]))


def test_chains_are_followed_to_their_end(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w3")]
    got = {r.word: r.root for r in spelling.follow(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: "w11" for w, _ in links}


def test_odd_rows(spark):
    """Null and empty texts, null and repeated ids, repeated rows, ties, a very long word, an empty table, clashing columns."""
    long = "z" * 3000
    rows = [(1, None), (None, "Hello hello HELLO hallo"), (2, ""), (3, "hallo hallo hallo hillo hillo hillo"), (3, "hallo hallo hallo hillo hillo hillo"), (4, f"{long} {long} {long} {long}y {long}y {long}y {long}y {long}y {long}y"), (5, "ÉTUDE étude étude étude Étude")]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert found(spelling.variants(docs)) == formed(counted(rows))
    assert spelling.variants(docs.limit(0)).collect() == []
