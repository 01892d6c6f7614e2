"""The bounded ranking against all pairs, and how many pairs it scores."""

import random

import pytest

from lectorium.operators import search

QUERY, DOC = "project_id long, query_id long, text string", "project_id long, doc_id long, text string"


def corpus(spark, seed, n=400):
    """Two courses; frequent words in every text, those of one of forty subjects in few, some texts equal."""
    rng = random.Random(seed)
    common, subjects = [f"common{i}" for i in range(12)], [[f"rare{i}x{j}" for j in range(8)] for i in range(40)]
    text = lambda k: " ".join(rng.choices(common, k=20) + rng.sample(rng.choice(subjects), k))
    docs = [(i % 2, i, text(rng.randrange(5))) for i in range(n)]
    docs += [(0, n + i, docs[0][2]) for i in range(15)] + [(1, 2 * n, None), (1, 2 * n + 1, "")]
    queries = [(i % 2, i, text(5)) for i in range(10)] + [(0, 90, docs[0][2]), (1, 91, "unknown words"), (0, 92, None), (5, 93, "common1")]
    return spark.createDataFrame(queries, QUERY), spark.createDataFrame(docs, DOC)


def best(rows, k):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    return {q: sorted(x)[:k] for q, x in out.items()}


@pytest.mark.parametrize("k,lead", [(1, 1), (8, 8), (8, 2), (50, 20)])
def test_the_best_are_those_of_all_pairs(spark, k, lead):
    queries, docs = corpus(spark, k + lead)
    got = search.tfidf_top(queries, docs, k, lead=lead).collect()
    assert best(got, k) == best(search.tfidf_rank(queries, docs).collect(), k)
    for q in {r.query_id for r in got}:
        assert sorted(r["rank"] for r in got if r.query_id == q) == list(range(1, 1 + sum(r.query_id == q for r in got)))


def test_few_pairs_are_scored(spark):
    queries, docs = corpus(spark, 7, 2000)
    keys = ("project_id", "query_id", "doc_id")
    q, d = search.tfidf_weights(queries, docs, *keys)
    first, more = search.tfidf_candidates(q, d, 8, 8, *keys)
    scored, pairs = first.count() + more.count(), search.tfidf_rank(queries, docs).count()
    assert scored < pairs / 3
    assert first.join(more, list(keys)).count() == 0  # none twice


def test_empty_tables(spark):
    queries, docs = corpus(spark, 1)
    assert search.tfidf_top(queries.limit(0), docs, 5).collect() == [] and search.tfidf_top(queries, docs.limit(0), 5).collect() == []


def test_the_query_gives_every_pair(spark, monkeypatch):
    """A query with more documents than fifty keeps them all."""
    import lectorium.plans  # noqa: F401  (fills the registry)
    from lectorium import registry
    from lectorium.sources.views import Views

    docs = spark.range(60).selectExpr("0 as project_id", "id as doc_id", "concat('common word', id) as text")
    items = spark.createDataFrame([(0, "common thing")], "item_id long, text string")
    monkeypatch.setattr(Views, "__getitem__", lambda self, name: {"benchmark": items, "slide_pages": docs}[name])
    assert registry.QUERIES["tfidf_rank"](spark, "").count() == 60 and "QUALIFY" not in registry.SQL["tfidf_rank"]
