import numpy as np
import pytest

from lectorium.llm import ann

SMALL = ann.Quantiser(books=6, words=32, sample=500, rounds=4, lane=200, query_block=16, tile=8)


def exact(rows, k=20, every=20):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            near = sorted(((-float(x @ y), i) for i, y in good if i != q))[:k]
            out[q] = [i for _, i in near]
    return out


def recall(got, want):
    return np.mean([len(set(got[q]) & set(w)) / len(w) for q, w in want.items()])


def answers(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r)
    return found


def test_recall_and_scores_on_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    found = answers(ann.search(table))
    want = exact(rows)
    assert found.keys() == want.keys()
    assert recall({q: [r.vec_id for r in rs] for q, rs in found.items()}, want) >= 0.9
    by = dict(rows)
    for q, rs in found.items():
        assert [r["rank"] for r in rs] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        for r in rs:
            assert r.score == pytest.approx(float(np.dot(by[q], by[r.vec_id])), abs=1e-12)


def test_unusable_vectors_ties_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (100, [None, 1.0]),
            (3, [0.5, 0.5]), (2, [0.5, 0.5]), (120, [1.0, 2.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as label", "2 as v")
    found = answers(ann.search(table, q=SMALL))
    assert {q: [(r.vec_id, r.score) for r in rs] for q, rs in found.items()} == {0: [(120, 1.0), (2, 0.5), (3, 0.5)], 120: [(2, 1.5), (3, 1.5), (0, 1.0)]}
    assert ann.search(table.limit(0)).count() == 0


def test_beam_search_is_no_worse_than_greedy():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    books = ann.fit_books(x, SMALL)
    made = lambda codes: sum(books[i][codes[:, i]] for i in range(len(books)))
    errors = []
    for beam in (1, 8):
        codes, norms = ann.encode(x, books, beam)
        y = made(codes)
        assert np.allclose((y**2).sum(1), norms, rtol=1e-4)
        errors.append(((x - y) ** 2).sum())
    assert errors[1] < errors[0]
