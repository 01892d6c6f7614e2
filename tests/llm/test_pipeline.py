import collections
import itertools
import math
import re

import regex
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lectorium.llm import mixing, quality, simhash
from lectorium.llm.queries import tokenizer_path

from .test_mixing import copies
from .test_quality import brute as base_rules
from .test_simhash import similar

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def outputs(spark, sf, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{len(found)}")
        docs = spark.read.parquet(f"{folder}/{len(found)}")
        found.append(docs)
    return found


def test_columns(outputs):
    assert [d.columns for d in outputs[1:-1]] == [outputs[0].columns] * 4


def line_fails(x, r=quality.LineRules()):
    java = lambda p: p.replace(r"\z", r"\Z").replace("(?i:^\\s*", "(?i:^[ \\t]*")
    words = len(re.findall(r"[^\x20\x09-\x0D]+", x))
    if not words:
        return False
    dense = lambda p: len(re.findall(p, x)) * r.chars_per_symbol > len(x)
    unspaced = sum("\u0e00" <= c <= "\u0e7f" or "\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" for c in x)
    unclosed = not re.search(java(quality.CLOSED), x) and words < r.unclosed_words and unspaced < 2 * r.unclosed_words
    phrase = words < r.phrase_words and (regex.search(java(quality.NAVIGATION), x) or regex.search(quality.BOILERPLATE, x))
    return bool(unclosed or dense(quality.SYMBOLS) or dense(quality.SHOUTS) or phrase)


def test_quality_stage(outputs):
    want = {}
    for r in outputs[0].collect():
        lines = (r.text or "").split("\n")
        kept = "\n".join(x for x in lines if not line_fails(x))
        chars = lambda t: len(re.sub(r"[\x20\x09-\x0D]+", "", t))
        if not base_rules(r.text)["base_failed"] and 100 * (chars(r.text) - chars(kept)) <= 40 * chars(r.text):
            want[r.doc_id] = kept
    assert {r.doc_id: r.text for r in outputs[1].collect()} == want
    assert all(r.n_chars == len(r.text) for r in outputs[1].collect())


def test_near_duplicate_stage(outputs):
    texts = {r.doc_id: r.text for r in outputs[1].collect()}
    prints = {i: simhash.fingerprint(t, 5) & (1 << 64) - 1 for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(texts), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 7 and similar(texts[i], texts[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    assert sorted(r.doc_id for r in outputs[2].collect()) == [i for i in sorted(texts) if find(i) == i]


def test_repeats_stage(outputs):
    n, rows = 200, outputs[2].collect()
    raw = {r.doc_id: r.text.encode() for r in rows}
    seen = collections.Counter(hash(t[i : i + n]) for t in raw.values() for i in range(len(t) - n + 1))
    want = {}
    for i, t in raw.items():
        gone = bytearray(len(t))
        for j in range(len(t) - n + 1):
            if seen[hash(t[j : j + n])] > 1:
                gone[j : j + n] = b"\1" * n
        want[i] = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
    assert {r.doc_id: r.text for r in outputs[3].collect()} == want


def test_mixing_stage(outputs):
    rates = {r.source: r.rate for r in mixing.repetition_rates(outputs[3]).collect()}
    n = collections.Counter(r.source for r in outputs[3].collect())
    wish = sum(round(math.sqrt(v), 6) for v in n.values())
    for s, v in n.items():
        assert rates[s] == pytest.approx(round(math.sqrt(v), 6) / wish * sum(n.values()) / v, abs=1e-6)
    got = collections.Counter(r.doc_id for r in outputs[4].collect())
    assert got == {r.doc_id: k for r in outputs[3].collect() if (k := copies("mix-1", r.doc_id, rates[r.source]))}


def test_encoding_stage(outputs):
    library = Tokenizer.from_file(tokenizer_path())
    texts = {r.doc_id: r.text for r in outputs[4].collect()}
    rows = outputs[5].collect()
    assert len(rows) == outputs[4].count()
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_text == texts[r.doc_id]


def test_run_gives_the_same_rows(spark, sf, outputs):
    key = lambda r: (r.doc_id, r.n_tokens)
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, outputs[5].collect()))


def test_stages_take_odd_rows_and_columns(spark, sf, documents):
    body = "\n".join(" ".join(f"w{i * 31 + j}" for j in range(14)) + "." for i in range(20))
    items = [(1, body), (1, body), (None, body + " More words."), (2, None), (3, ""), (None, None), (4, body.upper()), (5, "long " * 100_000)]
    docs = documents(items).selectExpr("*", "1 as kept", "'x' as copy", "2 as k1", "3 as n_spans", "4 as fp", "5 as `odd name`")
    rows = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect())
    good = corpus_pipeline.quality_rules(spark, docs, sf)
    assert rows(good) == [(False, 1, body), (False, 1, body), (False, 4, body.upper()), (True, 0, body + " More words.")]
    assert rows(corpus_pipeline.near_duplicates(spark, good, sf)) == [(False, 1, body)]
    odd = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert rows(odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))) == [(False, 1, body), (False, 2, ""), (False, 5, "long " * 100_000)]
    cut = corpus_pipeline.repeated_substrings(spark, good, sf)
    assert rows(cut) == [(False, 1, ""), (False, 1, ""), (False, 4, body.upper()), (True, 0, " More words.")]
    assert [r.n_chars for r in cut.where("doc_id = 4").collect()] == [len(body)]
    whole = corpus_pipeline.repeated_substrings(spark, docs, sf)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text is None) for r in whole.collect()) == sorted((i is None, i or 0, t is None) for i, t in items)
    assert {r.doc_id for r in corpus_pipeline.source_mixing(spark, docs, sf).collect()} <= {i for i, _ in items}
    for stage in [f for _, f in corpus_pipeline.STAGES[:-1]]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.where("false"), sf).count() == 0
    docs = good
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()
