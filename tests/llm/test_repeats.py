import hashlib
import random
from collections import Counter

import pytest

from lectorium.llm import repeats, substring, suffix_merge
from lectorium.llm.repeats import Window

BYTES = Window("byte", 12, 4, 1000, 20)
WORDS = Window("word", 6, 2, 1000)


def brute(texts, split, length):
    """Covered places of every text."""
    seqs = [split(t or "") for t in texts]
    seen = Counter(tuple(s[i : i + length]) for s in seqs for i in range(len(s) - length + 1))
    return seqs, [{j for i in range(len(s) - length + 1) if seen[tuple(s[i : i + length])] > 1 for j in range(i, i + length)} for s in seqs]


def runs(places):
    return sum(1 for p in places if p - 1 not in places)


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "be", "gämma", "d", "ep", "zeta", "eta"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [make(12) for _ in range(4)]
    texts = [None, "", "a", "abab" * 30, "xy" * 40, "xy" * 41, "b" * 19, "b" * 21, "same text here " * 5, "same text here " * 5]
    for _ in range(60):
        parts = [make(rng.randrange(9))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            parts += [p[rng.randrange(5) : len(p) - rng.randrange(5)], make(rng.randrange(7))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts))
    base = make(80)
    for _ in range(12):
        w = base.split()
        w[rng.randrange(80)] = "edit"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("rows", [1000, 8, 1])  # 1: every group is split down to single windows
def test_bytes_equal_brute_force(documents, rows):
    texts = corpus(1)
    w = Window("byte", 12, 4, rows, 20)
    seqs, covered = brute(texts, lambda t: list(t.encode()), 20)
    shorter = brute(texts, lambda t: list(t.encode()), 12)[1]
    got = {r.doc_id: r for r in suffix_merge.removal_digest(documents(texts), w).collect()}
    assert len(got) == len(texts) and any(covered)
    for i, (s, c) in enumerate(zip(seqs, covered, strict=True)):
        kept = bytes(b for j, b in enumerate(s) if j not in c)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(s), len(c), runs(c), hashlib.sha256(kept).hexdigest()), (i, texts[i])
        assert r.n_repeated == len(shorter[i])


@pytest.mark.parametrize("rows", [1000, 8, 1])
def test_words_equal_brute_force(documents, rows):
    texts = corpus(2)
    w = Window("word", 6, 2, rows)
    seqs, covered = brute(texts, lambda t: t.encode().split(), 6)
    got = {r.doc_id: r for r in substring.remove_repeats(documents(texts), w, digest=True).collect()}
    for i, (s, c) in enumerate(zip(seqs, covered, strict=True)):
        kept = b" ".join(x for j, x in enumerate(s) if j not in c)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(s), len(c), hashlib.sha256(kept).hexdigest()), (i, texts[i])


def test_long_texts_are_hashed_in_chunks(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abc") for _ in range(3000))
    code = repeats.coder(BYTES)
    whole = repeats.find_anchors(code(text), BYTES)
    monkeypatch.setattr(repeats, "CHUNK", 100)
    parts = repeats.find_anchors(code(text), BYTES)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_batches_keep_groups_together(documents, monkeypatch):
    monkeypatch.setattr(suffix_merge, "BATCH_ROWS", 7)
    texts = corpus(3)
    seqs, covered = brute(texts, lambda t: list(t.encode()), 20)
    got = {r.doc_id: r.n_removed for r in suffix_merge.removal_digest(documents(texts), BYTES).collect()}
    assert got == {i: len(c) for i, c in enumerate(covered)}


def test_rows_columns_and_empty_tables(documents):
    assert suffix_merge.removal_digest(documents([]), BYTES).count() == 0
    assert substring.remove_repeats(documents([]), WORDS).count() == 0
    docs = documents([(5, "ä" * 30), (5, "ä" * 30), (None, "unlike anything else here"), (6, None)]).selectExpr("*", "1 as k1", "2 as kept", "3 as n_spans")
    rows = suffix_merge.remove_repeats(docs, BYTES).collect()
    assert sorted((r.n_removed, r.text) for r in rows if r.text is not None) == [(0, "unlike anything else here"), (60, ""), (60, "")]
    assert [r.n_removed for r in rows if r.text is None] == [0]
    assert {(r.k1, r.kept) for r in rows} == {(1, 2)}
    assert len(substring.remove_repeats(docs, WORDS).collect()) == 4


def test_matching_statistics():
    a = substring.SuffixAutomaton()
    a.add(list("abcab"))
    a.add(list("xbcy"))
    a.finish()
    assert list(a.matching_statistics(list("abcabc"))) == [1, 2, 2, 1, 2, 2]
