import random
import re

import pytest
import xxhash

from lectorium.llm import simhash
from lectorium.llm.common import text_key


def fp(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ps = sorted(root)
    for i, a in enumerate(ps):
        for b in ps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in ps}


def test_fingerprints_equal_a_plain_version(documents):
    rng = random.Random(2)
    texts = [None, "", "  \n", "One", "two Words", "ÀÉ àé ABC abc", "a b c a b c a b c", " ".join(rng.choice("abcdefg") for _ in range(500))]
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(documents(texts)).collect()}
    assert got == {i: f"{fp(t):016x}" for i, t in enumerate(texts)}


@pytest.mark.parametrize("posting", [64, 4, 1])
def test_components_equal_all_pairs(spark, posting):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        q = p
        for _ in range(rng.randrange(6)):  # chains
            q ^= 1 << rng.randrange(64)
            q ^= 1 << rng.randrange(64)
            prints.add(q)
    center = rng.getrandbits(64)
    prints |= {center ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(i)}  # a crowd
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.v: r.root for r in simhash.components(simhash.links(nodes, posting)).collect()}
    want = brute(prints)
    groups = {}
    for p, r in want.items():
        groups.setdefault(r, set()).add(p - (1 << 64) if p >> 63 else p)
    for g in groups.values():
        assert {roots.get(p, p) for p in g} == {min(g)}


def test_rows_ids_and_columns(documents):
    text = " ".join(f"w{i}" for i in range(400))
    near = text + " extra"
    docs = documents([(9, text), (4, near), (4, near), (None, text), (7, None), (8, " "), (2, "far away from all others")]).selectExpr("*", "1 as fp", "2 as root")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    linked = (fp(text) ^ fp(near)).bit_count() <= 2
    first = 4 if linked else 9
    assert got == [(False, 2, 2), (False, 4, 4), (False, 4, 4), (False, 7, 7), (False, 8, 7), (False, 9, first), (True, 0, first)]
    kept = simhash.keep_first(docs)
    assert set(kept.columns) == set(docs.columns)
    assert sorted(r.doc_id for r in kept.collect()) == ([2, 4, 7] if linked else [2, 4, 7, 9])
    assert simhash.near_duplicates(documents([])).count() == 0


def similar(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()})
    union = sets[0] | sets[1]
    return not union or len(sets[0] & sets[1]) / len(union) >= 0.8


@pytest.mark.parametrize(("posting", "tile"), [(64, 1 << 20), (4, 16)])
def test_similar_texts_equal_all_pairs(documents, posting, tile):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = ["", " ", "One two", "one TWO", "three"]
    for size, n in [(30, 4), (120, 40), (200, 6), (300, 6), (90, 1), (90, 1)]:  # a crowd among small groups
        base = [word() for _ in range(size)]
        for k in range(n):
            near = list(base)
            for _ in range(k % 7):
                near[rng.randrange(size)] = word()
            texts.append(" ".join(near))
    prints = [simhash.fingerprint(t, 5) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 7 and similar(texts[i], texts[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    docs, groups = documents(texts), {}
    roots = {(r.k1, r.k2): r.root for r in simhash.similar_groups(docs, 5, 7, 0.8, posting, tile).collect()}
    for i, r in enumerate(docs.select(*text_key(docs.text)).collect()):
        groups.setdefault(roots[r.k1, r.k2], set()).add(find(i))
    want = sorted({find(i) for i in range(len(texts))})
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(want)
    assert sorted(r.doc_id for r in simhash.keep_first(docs, 5, 7, 0.8).collect()) == want
    assert simhash.keep_first(documents([]), 5, 7, 0.8).count() == 0


def test_pipeline_stage_drops_a_copy_that_is_three_bits_away(spark, documents):
    from corpus_pipeline import near_duplicates

    rng = random.Random(3)
    while True:
        words = [f"w{rng.randrange(9000)}" for _ in range(300)]
        text, near = " ".join(words), " ".join(words[:150] + ["changed"] + words[151:])
        if (fp(text) ^ fp(near)).bit_count() > 2 and ((simhash.fingerprint(text, 5) ^ simhash.fingerprint(near, 5)) & (2**64 - 1)).bit_count() <= 7:
            break
    assert [r.doc_id for r in near_duplicates(spark, documents([text, near]), "").collect()] == [0]


@pytest.mark.parametrize("rule", [(), (5, 7, 0.8)])
def test_rows_stay_by_their_own_component(documents, rule):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    docs = documents([(1, a), (1, b), (None, c), (None, d), (None, d), (2, e), (3, e), (3, b)])
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in simhash.keep_first(docs, *rule).collect())
    assert kept == [(False, 1, a), (False, 1, b), (False, 2, e), (True, 0, c), (True, 0, d)]
