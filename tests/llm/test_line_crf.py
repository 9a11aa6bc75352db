"""The line CRF: marginals by enumeration, blocks, training, whole predictions, held-out labels."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lettermill.llm import line_crf, queries

from .fixtures import empty, frame

PROSE = "The quick brown fox jumps over the lazy dog.\nIt was seen by many, and they said so."
JUNK = "BUY!! NOW!! BUY!! NOW!! BUY!!\n| a | b | c | d | e |"


def random_model(seed=3):
    rng = np.random.default_rng(seed)
    weights = rng.normal(0, 0.4, (3, len(line_crf.FEATURES), line_crf.STEPS + 1, 2))
    return line_crf.Model(weights, rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2), 1.3, 0.2)


def by_enumeration(model, nodes):
    """Marginals of good from the sum over all label sequences."""
    score, total, good = model.emissions(nodes), 0.0, np.zeros(len(nodes))
    for path in itertools.product((0, 1), repeat=len(nodes)):
        energy = model.start[path[0]] + sum(score[k, x] for k, x in enumerate(path)) + sum(model.transitions[a, b] for a, b in itertools.pairwise(path))
        total += np.exp(energy)
        good += np.exp(energy) * np.array(path)
    return good / total


TEXTS = ["one line", "", " \n\t\n", PROSE + "\n\n" + JUNK + "\nend", "same\nsame\nother\nsame\n" * 2, "é ü ß\n中文\n\U0001f600\U0001f600!"]


def test_document_share_is_the_weighted_marginal():
    model = random_model()
    share, lines, _ = line_crf.score_texts(model, pa.array(TEXTS, pa.string()))
    for text, got, n in zip(TEXTS, share, lines, strict=True):
        kept = [line for line in text.split("\n") if line.strip()]
        assert n == max(1, len(kept))
        own = line_crf.describe(np.frombuffer(text.encode(), np.uint8), np.zeros(1, np.int64))
        assert own.size.tolist() == ([len(x) + (text.find(x + "\n") >= 0) for x in kept] or [1])
        good = by_enumeration(model, line_crf.chain(own))
        assert got == pytest.approx((good * own.size).sum() / own.size.sum())


def test_results_do_not_depend_on_batches_or_blocks():
    model, rng = random_model(5), np.random.default_rng(1)
    lines = [PROSE, JUNK, "x" * 9_000, "é" * 5_000, "", "same", "same", "12 34"]
    texts = ["\n".join(lines[k] for k in rng.integers(0, len(lines), 60)) for _ in range(6)] + ["y" * 50_000, "\n" * 50_000, "a\n" * 20_000]
    whole = line_crf.score_texts(model, pa.array(texts, pa.string()), block=1 << 24)
    for block in (1, 9_000, 30_000):
        for own, text in enumerate(texts):
            share, n, bad = line_crf.score_texts(model, pa.array([text], pa.string()), block=block)
            assert share[0] == pytest.approx(whole[0][own], abs=1e-9) and (n[0], bad[0]) == (whole[1][own], whole[2][own]), (block, own)


def test_lines_of_bad_documents_are_told_apart():
    samples = [(1, f"{PROSE}\n{PROSE} {k}") for k in range(40)] + [(0, f"{PROSE}\n{JUNK}\n{JUNK} {k}") for k in range(40)]
    model = line_crf.train(samples)
    mixed = f"{PROSE}\n{JUNK}\n{PROSE}"
    own = line_crf.describe(np.frombuffer(mixed.encode(), np.uint8), np.zeros(1, np.int64))
    nodes = line_crf.chain(own)
    good = line_crf.forward_backward(model.emissions(nodes), line_crf._firsts(own.owner), model.transitions, model.start)[2][:, 1]
    assert (good[[0, 1, 4, 5]] > 0.5).all() and (good[[2, 3]] < 0.5).all()


def test_held_out_labels(spark, sf_dir):
    rows = queries.QUERIES["op11_line_crf_quality"](spark, "/root/testdata/sf0.01" if sf_dir.endswith("sf0.001") else sf_dir).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([s for s, q in held if q == x] for x in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.98
    assert np.mean([s >= 0.3 for s in good]) > 0.97 and np.mean([s < 0.3 for s in bad]) > 0.8


def test_awkward_rows(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (4, 1), (6, 1), (11, 0), (99, 1), (None, 1), (7, None), (8, 5)], "doc_id long, quality int")
    model = line_crf.fit(docs, labels, line_crf.fold("doc_id", 5) >= 0)
    got = line_crf.predict(docs, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    same = {r["doc_id"]: r["score"] for r in got}
    assert same[3] == same[4] == same[5] and same[6] == same[7]
    assert {r["score"] for r in line_crf.predict(docs, line_crf.fit(docs, labels.where("false"), line_crf.fold("doc_id", 5) >= 0)).collect()} == {0.5}
    one_class = line_crf.fit(docs, labels.where("quality = 1"), line_crf.fold("doc_id", 5) >= 0)
    assert all(0 <= r["score"] <= 1 for r in line_crf.predict(docs, one_class).collect())
    assert line_crf.fit(empty(spark), labels, line_crf.fold("doc_id", 5) >= 0) is None and line_crf.predict(empty(spark), model).count() == 0
