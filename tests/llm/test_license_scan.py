import os
import random

import pytest

from lectorium.llm import license_scan
from lectorium.llm.license_scan import TEMPLATES, Index, Scan

INDEX = Index(TEMPLATES, Scan())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_every_template_is_found_in_its_place():
    for name, body in TEMPLATES.items():
        text = "Some words before it.\n" + body.upper().replace(", ", ",\n   ") + "\nand after."
        found = {m[0]: m for m in INDEX.scan(text)}
        assert name in found and found[name][1] == 1.0, name
        _, _, n, start, end = found[name]
        assert n == len(license_scan.folded(body)[0])
        assert text[start:end].lower().split()[0] == body.lower().split()[0].strip('"')


def test_edits_inside_the_band_and_two_matches():
    words = TEMPLATES["MIT header"].split()
    edited = words[:10] + ["really"] + words[10:20] + words[22:40] + ["new", "words"] + words[40:]
    text = " ".join(edited) + " middle text here " * 20 + " ".join(edited)
    found = [m for m in INDEX.scan(text) if m[0] == "MIT header"]
    own = license_scan.folded(TEMPLATES["MIT header"])[0]
    assert len(found) == 2
    assert all(m[2] == lcs(own, license_scan.folded(" ".join(edited))[0]) for m in found)


def test_other_text_matches_nothing():
    assert INDEX.scan("the license of this work is in the house of the public version") == []


def test_rows(documents):
    docs = documents([(1, None), (2, ""), (2, "x Licensed under CC BY-NC 4.0. y"), (2, "x Licensed under CC BY-NC 4.0. y"), (None, "word " * 50_000)]).selectExpr("*", "1 as template")
    rows = license_scan.scan(docs).collect()
    assert sorted((r.doc_id or 0, r.template or "", r.span_start or 0, r.span_end or 0) for r in rows) == [
        (0, "", 0, 0), (1, "", 0, 0), (2, "", 0, 0), (2, "CC-BY-NC-4.0", 2, 29), (2, "CC-BY-NC-4.0", 2, 29)]
    assert license_scan.scan(documents([])).count() == 0


def test_query_equals_a_scan_of_every_diagonal(spark, sf):
    """Every diagonal on which enough words of the template stand near is aligned, without fingerprints or votes."""
    from lectorium.llm.queries import op5_license_scan

    s, want = Scan(), set()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for i, text in docs:
        words = license_scan.folded(text or "")[0]
        for t, own in enumerate(INDEX.words):
            near = [0]
            for w in words:
                near.append(near[-1] + (w in own))
            least = len(own) if INDEX.short[t] else -(-s.coverage * len(own) // 100)
            for d in range(-len(own), len(words)):
                a, z = max(0, d - s.band), min(len(words), d + len(own) + s.band)
                if z > a and near[z] - near[a] >= least and len(INDEX.align(words, t, d)) >= least:
                    want.add((i, INDEX.names[t]))
                    break
    found = {(r.doc_id, r.template) for r in op5_license_scan(spark, sf).collect()}
    assert {i for i, _ in found} == {i for i, _ in docs}
    assert {x for x in found if x[1]} == want and want


def long_texts(n=3, size=1500):
    """Long texts that share a tenth of their sentences, as licenses do."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    shared = [" ".join(word() for _ in range(12)) for _ in range(12)]
    return {f"long {i}": ". ".join(rng.choice(shared) if k % 10 == 0 else " ".join(word() for _ in range(12)) for k in range(size // 12)) for i in range(n)}


def edited(text, rng, changed):
    return " ".join("changed" if rng.random() < changed else w for w in text.split())


@pytest.mark.parametrize("changed", [0.0, 0.05, 0.12])
def test_long_texts_with_passages_put_in_and_left_out(changed):
    rng, texts = random.Random(1), long_texts()
    index = Index(texts, Scan())
    for name, body in texts.items():
        words = edited(body, rng, changed).split()
        split = words[:400] + ["inserted"] * 90 + words[400:800] + words[880:] + ["x"] * 50
        found = index.scan("before it " + " ".join(split))
        assert [m[0] for m in found] == [name] and 0.8 <= found[0][1] < 1.0
        own, there = license_scan.folded(body)[0], license_scan.folded("before it " + " ".join(split))[0]
        assert found[0][2] >= 0.99 * lcs(own, there)  # a band leaves out little of the best alignment


def test_what_long_texts_have_in_common_is_no_match():
    texts = long_texts()
    index = Index(texts, Scan())
    assert index.scan(" ".join(texts["long 0"].split()[:500])) == []  # a third of it
    sentence = texts["long 0"].split(". ")[0]
    assert index.candidates(license_scan.folded(sentence)[0]) == {}  # one sentence that others share: not even aligned


def test_templates_from_a_folder(spark, documents, tmp_path):
    for name, text in long_texts().items():
        (tmp_path / name.replace(" ", "-")).write_text(text)
    templates = license_scan.read_templates(spark, str(tmp_path))
    assert sorted(templates) == ["long-0", "long-1", "long-2"]
    rows = license_scan.scan(documents(["see " + templates["long-1"], "nothing"]), templates).collect()
    assert [(r.doc_id, r.template, r.coverage) for r in sorted(rows, key=lambda r: r.doc_id)] == [(0, "long-1", 1.0), (1, None, None)]
    with pytest.raises(ValueError, match="too many"):
        license_scan.read_templates(spark, str(tmp_path), Scan(most_words=100))


COMMON = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no full license texts on this machine")
def test_full_licenses_are_told_apart():
    names = [n for n in ("Apache-2.0", "Artistic", "BSD", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0") if os.path.exists(f"{COMMON}/{n}")]
    texts = {n: open(f"{COMMON}/{n}", encoding="utf-8").read() for n in names}
    index = Index(texts, Scan())
    for name, body in texts.items():
        assert [m[0] for m in index.scan("Copyright somebody\n" + edited(body, random.Random(2), 0.03))] == [name]
