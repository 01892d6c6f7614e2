import hashlib
import math

import pytest

from lectorium.llm import mixing


def copies(seed, doc_id, rate):
    u = int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, p = 0, math.exp(-rate)
    c = p
    while u >= c:
        k += 1
        p *= rate / k
        c += p
    return k if rate > 0 else 0


def test_copies_invert_the_distribution(spark, documents):
    docs = documents([f"text {i}" for i in range(300)], [None if i % 7 == 0 else f"s{min(i % 5, 2)}" for i in range(300)])
    rates = {r.source: r.rate for r in mixing.repetition_rates(docs, flatten=0.0).collect()}
    got = {}
    for r in mixing.mix(docs, flatten=0.0, seed="s").collect():
        got.setdefault(r.doc_id, []).append(r.copy)
    for r in docs.collect():
        n = copies("s", r.doc_id, rates[r.source])
        assert sorted(got.get(r.doc_id, [])) == list(range(1, n + 1))


def test_weights_are_reached(documents):
    n = 6000
    docs = documents(["x"] * n, ["a" if i % 3 else "b" for i in range(n)])
    out = mixing.mix(docs, weights={"b": 3.0, "a": 1.0}, epochs=2.0)
    by = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(by["b"] / (2 * n) - 0.75) < 0.03 and abs(by["a"] / (2 * n) - 0.25) < 0.03


def test_order_does_not_depend_on_partitions(documents):
    docs = documents([f"t{i}" for i in range(100)])
    a = {(r.doc_id, r.copy, r.shuffle_key) for r in mixing.mix(docs).collect()}
    b = {(r.doc_id, r.copy, r.shuffle_key) for r in mixing.mix(docs.repartition(7)).collect()}
    assert a == b


def test_edge_cases(documents):
    assert mixing.mix(documents([])).count() == 0
    assert mixing.mix(documents(["a", "b"]), weights={}).count() == 0
    odd = documents([(None, None), (None, None), (3, "")]).selectExpr("*", "9 as rate", "8 as copy", "7 as `my col`")
    rows = mixing.mix(odd, epochs=3.0).collect()
    assert all(r["my col"] == 7 and r.rate != 9 for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.source), set()).add(r.copy)
    assert all(s == set(range(1, len(s) + 1)) for s in by.values())


@pytest.mark.parametrize("rate", [500, 1000, 10_000])
def test_large_rates(documents, rate):
    n, parts = 40, max(1, math.ceil(rate / 500))
    out = mixing.mix(documents(["x"] * n, ["a"] * n), weights={"a": 1.0}, epochs=float(rate), seed="s")
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: copies("s", i, rate / parts) + sum(copies(f"s:draw:{j}", i, rate / parts) for j in range(2, parts + 1)) for i in range(n)}
    mean = sum(got.values()) / n
    assert abs(mean - rate) < 5 * math.sqrt(rate / n)
    assert 0.3 * rate < sum((k - mean) ** 2 for k in got.values()) / (n - 1) < 2.5 * rate


@pytest.mark.parametrize("unit", [1.0, 4e-7, 1e-300, 1e12])
def test_weights_of_any_size(documents, unit):
    """Equal shares at any scale, and shares of three to one."""
    docs = documents(["x"] * 2000, ["a", "b"] * 1000)
    for a, b in ((1, 1), (3, 1)):
        rates = {r.source: r.rate for r in mixing.repetition_rates(docs, weights={"a": a * unit, "b": b * unit}).collect()}
        assert rates == {"a": pytest.approx(2 * a / (a + b), rel=1e-12), "b": pytest.approx(2 * b / (a + b), rel=1e-12)}
    assert abs(mixing.mix(docs, weights={"a": unit, "b": unit}).count() - 2000) < 200


def test_a_small_source_is_not_dropped(documents):
    docs = documents(["x"] * 3000, ["a"] * 1000 + ["b"] * 1000 + ["c"] * 1000)
    rates = {r.source: r.rate for r in mixing.repetition_rates(docs, weights={"a": 1.0, "b": 4e-7, "c": 1e-9}).collect()}
    assert rates["b"] == pytest.approx(3 * 4e-7, rel=1e-6) and rates["c"] == pytest.approx(3 * 1e-9, rel=1e-6)
    # a million epochs later the smallest has its thousand times three copies
    got = {r.source: r["count"] for r in mixing.mix(docs.where("source <> 'a'"), weights={"b": 4e-7, "c": 1e-9}, epochs=20.0).groupBy("source").count().collect()}
    assert abs(got["c"] - 40_000 / 401) < 50 and got["b"] > 35_000


def test_rows_without_an_id_are_dealt_apart(documents):
    out = mixing.mix(documents([(None, f"text {i}") for i in range(1000)], ["a"] * 1000)).collect()
    kept, keys = {r.text for r in out}, {r.shuffle_key for r in out}
    assert 550 < len(kept) < 710 and len(keys) == len(out)  # 1 - 1/e of them, each in a place of its own


def test_sql_draws_rows_without_an_id_alike(spark, documents):
    import duckdb

    docs = documents([(None if i % 2 else i, None if i % 5 == 0 else f"text {i}") for i in range(200)], [None if i % 3 == 0 else "ab"[i % 2] for i in range(200)])
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    got = sorted(map(str, (tuple(r[c] for c in ("doc_id", "source", "lang", "text", "copy", "shuffle_key")) for r in mixing.mixing_query(docs).collect())))
    assert got == sorted(map(str, con.execute(f"SELECT doc_id, source, lang, text, copy, shuffle_key FROM ({mixing.SQL})").fetchall()))
