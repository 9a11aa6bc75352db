"""The persisted index: packing, exact results against plain scoring, blocks passed over, segments, merging, failures."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.operators import postings, retrieval
from lettermill.operators.staging import shared_dir


@pytest.mark.parametrize("n", [0, 1, 100, 255, 256, 300, 4095, 4096])
def test_slots_survive_packing(n):
    slots = np.sort(np.random.default_rng(n).choice(postings.SLOTS, n, replace=False))
    data = postings.encode(slots)
    assert np.array_equal(postings.decode(data), slots) and len(data) <= postings.SLOTS // 8 + 1


def texts(spark, n=20_000):
    """Many documents of very different lengths over a skewed vocabulary."""
    word = lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(40) + F.pmod(F.xxhash64(i, "id"), F.lit(400))).cast("string"))
    size = 2 + F.pmod(F.xxhash64("id"), F.lit(60)).cast("int")
    return spark.range(n).select(F.col("id").alias("key"), F.array_join(F.transform(F.sequence(F.lit(1), size), word), " ").alias("text"))


def indexed(spark, rows, parts):
    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    cells = F.transform(retrieval.tokens(F.col("text"), False), lambda t: F.struct(t.alias("term"), F.lit(None).cast("double").alias("weight")))
    for part in parts:
        postings.add(path, rows.where(part).select("key", cells.alias("cells")))
    return path


def ask(spark, queries):
    rows = spark.createDataFrame(queries, "query_id int, query string")
    return rows, rows.select("query_id", F.explode(retrieval.tokens(F.col("query"), False)).alias("term"), F.lit(True).alias("raw"))


QUERIES = [(1, "w1 w17 w300"), (2, "w5"), (3, "w2 w3 w4 w6 w7 w8 w9 w10"), (4, "unknown words"), (5, "w399 nothing w1")]


def test_same_results_as_scoring_everything(spark):
    rows = texts(spark).cache()
    queries, terms = ask(spark, QUERIES)
    want = {tuple(r) for r in retrieval.bm25(rows, queries, "key", "text", 10, morphology=False).select("query_id", "key", "score", "place").collect()}
    path = indexed(spark, rows, ["true"])
    found = postings.search_bm25(postings.open_index(spark, path), terms, 10)
    assert {tuple(r) for r in found.hits.select("query_id", "key", "score", "place").collect()} == want
    read = {r["query_id"]: (r["blocks"], r["read"]) for r in found.blocks.collect()}
    assert read[2][0] >= 5 and read[2][1] < read[2][0] and all(r <= b for b, r in read.values())

    path = indexed(spark, rows, ["key < 3000", "key >= 3000 and key < 15000", "key >= 15000"])
    assert {tuple(r) for r in postings.search_bm25(postings.open_index(spark, path), terms, 10).hits.select("query_id", "key", "score", "place").collect()} == want
    before = postings.open_index(spark, path)
    postings.merge(spark, path)
    after = postings.open_index(spark, path)
    assert (after.size, after.mean_length) == (before.size, before.mean_length) and after.documents.count() < before.documents.count()
    assert {tuple(r) for r in postings.search_bm25(after, terms, 10).hits.select("query_id", "key", "score", "place").collect()} == want
    assert after.documents.select("segment").distinct().count() == 1


def test_dot_products(spark):
    rng = np.random.default_rng(4)
    docs = [(f"d{k:03}", [(f"t{t}", float(w)) for t, w in zip(rng.choice(30, 6, replace=False), rng.integers(-1, 9, 6), strict=True)]) for k in range(200)] + [(None, [("t1", 5.0)]), ("none", None), ("zero", [("t1", 0.0)])]
    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    postings.add(path, spark.createDataFrame(docs, "key string, cells array<struct<term:string,weight:double>>"))
    asked = {(q, f"t{t}"): float(rng.integers(-2, 6)) for q in range(3) for t in range(12)}
    got = postings.search_dot(postings.open_index(spark, path), spark.createDataFrame([(q, t, w) for (q, t), w in asked.items()], "query_id int, term string, factor double"), 7)
    want = set()
    for q in range(3):
        scores = sorted((-sum(w * max(0, asked.get((q, t), 0)) for t, w in cells if w > 0), key) for key, cells in docs if key and cells)
        want |= {(q, key, -s, place) for place, (s, key) in enumerate([x for x in scores if x[0] < 0][:7], 1)}
    assert {tuple(r) for r in got.hits.select("query_id", "key", "score", "place").collect()} == want


def test_a_failed_addition_changes_nothing(spark, monkeypatch):
    path = indexed(spark, texts(spark, 50), ["key < 20"])
    monkeypatch.setattr(postings, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        indexed_again = texts(spark, 50).where("key >= 20").select("key", F.array().cast("array<struct<term:string,weight:double>>").alias("cells"))
        postings.add(path, indexed_again)
    assert postings.open_index(spark, path).size == 20
    assert postings.open_index(spark, path + "-absent") is None


def test_runs_are_coded_together():
    rng = np.random.default_rng(3)
    runs = [np.sort(rng.choice(postings.SLOTS, n, replace=False)) for n in (1, 2, 255, 256, 257, 4096, 1, 3000, 3)]
    edges = np.cumsum([0, *map(len, runs)])[:-1]
    coded = postings.encode_all(np.concatenate(runs), edges)
    assert coded.to_pylist() == [postings.encode(r) for r in runs]
    for part in (slice(0, 9), slice(2, 7), slice(4, 5), slice(0, 0)):
        slots, counts = postings.decode_all(coded[part.start : part.stop])
        assert counts.tolist() == [len(r) for r in runs[part]] and np.array_equal(slots, np.concatenate([np.zeros(0, np.int64), *runs[part]]))


def test_runs_go_on_over_batches(spark, tmp_path, monkeypatch):
    """No call a posting: a task's cells come in batches, whose borders do not show in the index."""
    rows = spark.range(300).selectExpr("id AS key", "array(named_struct('term', 'all', 'weight', cast(id + 1 AS double)), named_struct('term', cast(id AS string), 'weight', 2.0D)) AS cells")
    kept = []
    for size in (7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        postings.add(f"{tmp_path}/{size}", rows)
        index = postings.open_index(spark, f"{tmp_path}/{size}")
        kept.append(sorted(tuple(r) for r in index.postings.select("term", "block", "n", "low", "high", "slots", "weights").collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert kept[0] == kept[1] and len(kept[0]) == 301 and ("all", 0, 300, 1.0, 300.0) in [r[:5] for r in kept[0]]
    plans = []
    from pyspark.sql import GroupedData

    monkeypatch.setattr(GroupedData, "applyInArrow", lambda *a, **k: plans.append(a))
    postings.add(f"{tmp_path}/7", rows)
    assert not plans


def test_a_block_is_asked_only_for_terms_it_has(spark):
    """A query of many terms, each in one block: what is asked grows with the postings, not with terms times blocks."""
    n = 3 * postings.SLOTS
    rows = spark.range(n).select(F.col("id").alias("key"), F.array(F.struct(F.concat(F.lit("t"), F.floor(F.col("id") / 100)).alias("term"), (F.col("id") + 1.0).alias("weight"))).alias("cells"))
    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    postings.add(path, rows)
    index = postings.open_index(spark, path)
    asked = spark.range(n // 100 + 1).select(F.lit(1).alias("query_id"), F.concat(F.lit("t"), "id").alias("term"), F.lit(2.0).alias("factor"), F.lit(True).alias("raw"))
    chosen = index.documents.select(F.lit(1).alias("query_id"), "segment", "block", F.lit(0).alias("share"))
    held = {tuple(r) for r in index.postings.select("term", "segment", "block").collect()}
    found = postings._asking(index.postings, asked, chosen, ["segment", "block", "share"]).collect()
    assert len({b for *_, b in held}) == 3 and len(found) == len(held) < 2 * asked.count()
    assert {(r["term"], r["segment"], r["block"]) for r in found} == held and all(len(r["asking"]) == 1 for r in found)
    assert [tuple(r) for r in postings.search_dot(index, asked.drop("raw"), 3).hits.orderBy("place").select("key", "score").collect()] == [(n - k, 2.0 * (n - k + 1)) for k in (1, 2, 3)]
