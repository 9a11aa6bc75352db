"""Topics: the matrix against plain counting, planted topics, falling errors, weights that are at their optimum."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lettermill.operators import topics

THEMES = [["ship", "harbour", "sail", "anchor", "mast"], ["oven", "flour", "yeast", "bread", "crust"], ["court", "judge", "appeal", "ruling", "clerk"]]


def corpus(n=90, seed=1):
    rng = random.Random(seed)
    return [(k, " ".join(["the", *rng.choices(THEMES[k % 3], k=30), *rng.choices(["common", "shared"], k=3)])) for k in range(n)]


@pytest.fixture(scope="module")
def fitted(spark):
    data, vocabulary = topics.matrix(spark.createDataFrame(corpus(), "id long, body string"), "id", "body", 60)
    return data.cache(), vocabulary, topics.fit(data, vocabulary, 3, least_fall=1e-6)


def test_matrix_is_tf_idf_of_the_most_frequent_terms(spark):
    docs = [(1, "Apple pie and apple tart"), (2, "Apple juice"), (3, "pie pie pie"), (4, ""), (5, None), (6, "a I"), (7, "juice ÄPFEL")]
    data, vocabulary = topics.matrix(spark.createDataFrame(docs, "id long, body string"), "id", "body", 4, stop_words=["and"])
    words = {1: ["apple", "pie", "apple", "tart"], 2: ["apple", "juice"], 3: ["pie"] * 3, 7: ["juice", "äpfel"]}
    terms = {k: Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]) for k, w in words.items()}
    total = sum(terms.values(), Counter())
    assert vocabulary == sorted(sorted(total, key=lambda t: (-total[t], t))[:4])
    n = 5  # texts that are not blank
    for r in data.collect():
        own = {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + sum(t in x for x in terms.values()))) + 1) for t, c in terms[r["id"]].items() if t in vocabulary}
        length = math.sqrt(sum(v * v for v in own.values()))
        assert {vocabulary[c]: w for c, w in zip(r["cells"], r["weights"])} == {t: pytest.approx(v / length) for t, v in own.items()}


def test_planted_topics_are_found(fitted):
    _, _, model = fitted
    found = {frozenset(w for w in names if " " not in w and w not in ("common", "shared")) for _, _, names in model.top(5)}
    assert len(found) == 3 and all(any(f <= set(theme) for theme in THEMES) and f for f in found)
    assert all(b <= a + 1e-9 for a, b in zip(model.losses, model.losses[1:])) and len(model.losses) > 2


def test_weights_are_at_their_optimum(fitted):
    data, vocabulary, model = fitted
    got = np.zeros((90, 3))
    for r in topics.weights(data, "id", model, least=0.0).collect():
        got[r["id"], r["topic"]] = r["weight"]
    assert all(np.argmax(got[a]) == np.argmax(got[a + 3]) for a in range(87)) and len({int(np.argmax(got[a])) for a in range(3)}) == 3
    dense = np.zeros((90, len(vocabulary)))
    for r in data.collect():
        dense[r["id"], r["cells"]] = r["weights"]
    gradient = got @ (model.weights @ model.weights.T) - dense @ model.weights.T
    assert (gradient > -2e-3).all() and np.abs(gradient[got > 1e-3]).max() < 2e-3
    assert all(r["weight"] > 0.01 for r in topics.weights(data, "id", model).collect())


def test_singular_values(fitted):
    data, vocabulary, _ = fitted
    dense = np.zeros((90, len(vocabulary)))
    for r in data.collect():
        dense[r["id"], r["cells"]] = r["weights"]
    value, vectors = topics.singular(data, len(vocabulary), 4)
    assert value == pytest.approx(np.linalg.svd(dense, compute_uv=False)[:4], rel=0.01)
    assert np.linalg.norm(dense @ vectors.T, axis=0) == pytest.approx(value, rel=1e-6)


def test_sums_in_a_tree(spark):
    data = spark.range(500).repartition(70).selectExpr("id as key", "array(cast(id % 7 as int)) as cells", "array(cast(id as double)) as weights")
    total = topics._summed(data, lambda batch: [[np.bincount(b[1], b[2], minlength=40_000)] for b in topics._blocks(batch, 7)])
    want = np.zeros(7)
    np.add.at(want, np.arange(500) % 7, np.arange(500))
    assert np.array_equal(total[0][:7], want) and not total[0][7:].any()


def test_too_little_to_fit(spark):
    for rows in ([], [(1, "one text only")], [(1, None), (2, "")]):
        data, vocabulary = topics.matrix(spark.createDataFrame(rows, "id long, body string"), "id", "body")
        assert topics.fit(data, vocabulary, 3) is None and topics.weights(data, "id", None).count() == 0


def test_no_row_for_each_term_of_a_text(spark, monkeypatch):
    """Staged tables have a row a text; terms outside the vocabulary never travel by text."""
    staged, stage = [], topics.stage

    def kept(df, name):
        out = stage(df, name)
        staged.append((name, out.count()))
        return out

    monkeypatch.setattr(topics, "stage", kept)
    data, vocabulary = topics.matrix(spark.createDataFrame([*corpus(), (0, "ship ship"), (None, "ship sail")], "id long, body string"), "id", "body", 10)
    assert data.count() == 91 and all(n <= 92 for _, n in staged), staged
