import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lectorium.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """Every document for every item, in whole numbers."""
    counts = [(i, Counter(t := terms(x)), len(t)) for i, x in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c, n in counts:
            m = 10 + 90 * n * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank(d.repartition(3), i, **how).collect()), key=repr)


def corpus(seed, n=600):
    rng = random.Random(seed)
    words = ["the", "of", "and", *[f"w{i}" for i in range(300)], "Été", "été", "x1"]
    text = lambda: " ".join(rng.choice(words[: rng.choice([3, 20, 306])]) for _ in range(rng.randrange(60)))
    docs = [(i, text()) for i in range(n)]
    docs += [(1000 + i, "the same text of all w1 w2") for i in range(300)]  # ties
    return docs, [(i, text() + " w1 the") for i in range(12)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_scoring_every_document(spark, seed):
    docs, items = corpus(seed)
    assert ranked(spark, docs, items) == brute(docs, items)


def test_small_shards_and_several_rounds_change_nothing(spark, monkeypatch):
    docs, items = corpus(3)
    monkeypatch.setattr(lexical, "SHARD", 50)
    monkeypatch.setattr(lexical, "BLOCK", 8)
    assert ranked(spark, docs, items, most_terms=40, k=3) == brute(docs, items, 3)


def test_blocks_are_skipped(spark):
    """Two thousand documents hold frequent terms only; a rare term decides, so few are scored."""
    n, rare = 2048, 1500
    counts = np.array([2 if i == rare else 1 for i in range(n)])
    flat = np.concatenate([[0, 1] if i == rare else [0] for i in range(n)])
    request = lexical.Request([7], [np.array([0, 1])], np.array([1, lexical.weight(n, 1)]), n, n + 1)
    shard = lexical.Shard(np.ones(n, int), counts, flat, np.ones(len(flat), int), request)
    docs, scores, scored = shard.best(np.array([0, 1]), 0, 1)
    assert docs[np.argmax(scores)] == rare
    floor = int(scores.max())
    assert shard.best(np.array([0, 1]), floor, 1)[2] == 1  # once the score to beat is known
    assert scored < n


def test_odd_rows(spark):
    """Null, blank and repeated rows, null ids, items without terms or with unknown ones, items that share an id, NUL bytes."""
    docs = [(3, "a b"), (3, "a b"), (None, "a b"), (1, None), (2, " .,-"), (4, "a\x00B b a"), (5, "é É"), (6, "long " * 20_000 + "b")]
    items = [(1, "A"), (1, "b"), (None, "é"), (2, "zzz"), (3, None), (4, "...")]
    assert ranked(spark, docs, items) == brute(docs, items)
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == []


def test_other_columns_stay_out(spark):
    docs = spark.createDataFrame([(1, "a", 9, "x"), (2, "c", 9, "x")], "doc_id long, text string, score int, term string")
    items = spark.createDataFrame([(1, "a", 5)], "item_id long, text string, rank int")
    assert [tuple(r)[:3] for r in lexical.rank(docs, items).collect()] == [(1, 1, 1)]


def test_query_equals_brute_force(spark, sf):
    from lectorium.llm.queries import QUERIES

    read = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in QUERIES["op11_lexical_search"](spark, sf).collect()), key=repr)
    assert got == brute(read("documents", "doc_id"), read("benchmark", "item_id"))
