"""Late interaction: exact scores against plain loops, recall through the codes, corners."""

import numpy as np
import pytest

from lettermill.operators import late

SIZE = 16


def corpus(n, seed):
    """Documents around a few hundred themes, so that neighbours exist."""
    rng = np.random.default_rng(seed)
    themes = rng.normal(size=(200, SIZE))
    return [(k, [(themes[t] + 0.35 * rng.normal(size=SIZE)).astype(np.float32).tolist() for t in rng.choice(200, rng.integers(2, 9))]) for k in range(n)]


def plain(query, document):
    return round(sum(max(float(np.dot(np.array(q, np.float64), np.array(d, np.float64))) for d in document) for q in query), 6) if query and document else 0.0


@pytest.fixture(scope="module")
def data(spark):
    docs, queries = corpus(1500, 1), corpus(30, 2)
    make = lambda rows, name: spark.createDataFrame(rows, f"{name} long, vectors array<array<float>>")
    return docs, queries, make(docs, "doc_id").cache(), make(queries, "query_id")


def test_candidates_are_reranked_exactly(spark, data):
    docs, queries, documents, asked = data
    rng = np.random.default_rng(3)
    chosen = [(q, int(d), place) for q, _ in queries for place, d in enumerate(rng.choice(1500, 40, replace=False), 1)]
    got = {(r["query_id"], r["place"]): (r["doc_id"], r["score"]) for r in late.maxsim(asked, spark.createDataFrame(chosen, "query_id long, doc_id long, place int"), documents, SIZE, 10).collect()}
    for q, vectors in queries:
        scores = sorted((-plain(vectors, docs[d][1]), place, d) for own, d, place in chosen if own == q)[:10]
        assert [got[q, k] for k in range(1, 11)] == [(d, pytest.approx(-s, abs=2e-6)) for s, _, d in scores]


def test_recall_through_codes(data):
    docs, queries, documents, asked = data
    books = late.learn(documents, SIZE, 8)
    encoded = late.codes(documents, books)
    assert all(len(r["codes"]) == 8 * len(docs[r["doc_id"]][1]) for r in encoded.collect())
    got = {}
    for r in late.search(asked, documents, encoded, books, 10).collect():
        got.setdefault(r["query_id"], {})[r["doc_id"]] = r["score"]
    hits = 0
    for q, vectors in queries:
        best = sorted((-plain(vectors, d), i) for i, d in docs)[:10]
        hits += len(got[q].keys() & {i for _, i in best})
        assert all(score == pytest.approx(plain(vectors, docs[i][1]), abs=2e-6) for i, score in got[q].items())
    assert hits >= 0.9 * 10 * len(queries)


def test_corners(spark):
    documents = spark.createDataFrame([(1, None), (2, []), (3, [[1.0, 0.0], [1.0]]), (4, [[1.0, 0.0]]), (5, [[-1.0, 0.0]])], "doc_id long, vectors array<array<float>>")
    asked = spark.createDataFrame([(1, [[2.0, 0.0]]), (2, []), (3, None)], "query_id long, vectors array<array<float>>")
    pairs = spark.createDataFrame([(q, d, 6 - d) for q in (1, 2, 3) for d in range(1, 6)], "query_id long, doc_id long, place int")
    got = {(r["query_id"], r["place"]): (r["doc_id"], r["score"]) for r in late.maxsim(asked, pairs, documents, 2, 5).collect()}
    assert [got[1, k] for k in range(1, 6)] == [(4, 2.0), (3, 2.0), (2, 0.0), (1, 0.0), (5, -2.0)]
    assert [got[2, k][0] for k in range(1, 6)] == [5, 4, 3, 2, 1]
    books = late.learn(documents, 2, 1)
    assert {(r["query_id"], r["doc_id"]) for r in late.search(asked, documents, late.codes(documents, books), books).collect()} == {(1, 3), (1, 4), (1, 5)}
    assert late.learn(documents.where("doc_id < 3"), 2, 1) is None and late.search(asked.where("query_id > 1"), documents, late.codes(documents, books), books).count() == 0
