"""The vector store: commits, failures before them, replayed batches, the journal, checkpoints, search over both."""

import os
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lettermill.operators import retrieval
from lettermill.operators.staging import shared_dir
from lettermill.sources import vector_store as store

SCHEMA = "vec_id long, embedding array<float>, deleted boolean"


@pytest.fixture
def path(spark):
    store.register(spark)
    return f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"


def write(df, path):
    df.write.format("vector_store").option("path", path).mode("append").save()


def rows(spark, ids, seed=0, deleted=False, size=8):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.normal(size=size).astype(np.float32).tolist(), deleted) for i in ids], SCHEMA)


def held(spark, path):
    return {r["vec_id"]: tuple(r["embedding"]) for r in store.vectors(spark, path).collect()}


def test_last_commit_counts_and_checkpoints_change_nothing(spark, path):
    first, second = rows(spark, range(60), 1).repartition(3), rows(spark, range(50, 80), 2)
    write(first, path)
    write(second, path)
    write(rows(spark, [0, 55, 79], 3, deleted=True), path)
    want = {r["vec_id"]: tuple(r["embedding"]) for r in first.collect()} | {r["vec_id"]: tuple(r["embedding"]) for r in second.collect()}
    want = {i: v for i, v in want.items() if i not in (0, 55, 79)}
    assert held(spark, path) == want
    store.checkpoint(spark, path)
    assert held(spark, path) == want and store.current(path)["commit"] == 3
    write(rows(spark, [0, 1], 4), path)
    again = held(spark, path)
    assert again.keys() == want.keys() | {0} and again[1] != want[1]
    store.checkpoint(spark, path)
    assert held(spark, path) == again


def test_killed_before_the_commit_leaves_no_row(spark, path):
    write(rows(spark, range(5)), path)
    batch = pa.RecordBatch.from_pylist([{"vec_id": 9, "embedding": [1.0] * 8, "deleted": False}])
    lost = store.VectorWriter(path)
    message = lost.write(iter([batch]))
    assert message.rows == 1 and os.path.exists(f"{lost.path}/journal/{message.file}")
    assert held(spark, path).keys() == set(range(5))  # written, never committed
    lost.abort([message, None])
    assert not os.path.exists(f"{lost.path}/journal/{message.file}")


def test_a_failing_task_aborts_the_write(spark, path):
    bad = rows(spark, range(40)).repartition(4).withColumn("deleted", F.when(F.col("vec_id") == 17, F.raise_error(F.lit("lost")).cast("boolean")).otherwise(F.col("deleted")))
    with pytest.raises(Exception, match="lost"):
        write(bad, path)
    assert held(spark, path) == {} and not [c for c in os.listdir(store._local(path) + "/commits") if c.endswith(".json")]


def test_a_replayed_batch_is_written_once(spark, path):
    writer = store.VectorStreamWriter(path, "s")
    batch = pa.RecordBatch.from_pylist([{"vec_id": 1, "embedding": [1.0, 2.0], "deleted": False}])
    writer.commit([writer.write(iter([batch]))], 7)
    other = pa.RecordBatch.from_pylist([{"vec_id": 1, "embedding": [5.0, 5.0], "deleted": False}])
    writer.commit([writer.write(iter([other]))], 7)
    assert held(spark, path) == {1: (1.0, 2.0)} and len(os.listdir(writer.path + "/journal")) == 1


def test_stream_resumes_from_its_checkpoint(spark, path):
    source, state = f"{shared_dir(spark)}/in-{uuid.uuid4().hex}", f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source).writeStream.format("vector_store").option("path", path).option("checkpointLocation", state)
        stream.trigger(availableNow=True).start().awaitTermination()

    rows(spark, range(6), 1).write.parquet(source)
    run()
    commits = len(os.listdir(store._local(path) + "/commits"))
    assert held(spark, path).keys() == set(range(6))
    run()
    assert len(os.listdir(store._local(path) + "/commits")) == commits  # nothing new, nothing written
    rows(spark, range(4, 9), 2).write.mode("append").parquet(source)
    run()
    assert held(spark, path).keys() == set(range(9))


def test_search_reads_index_and_journal(spark, path):
    vectors = rows(spark, range(1500), 5, size=16)
    write(vectors.where("vec_id < 1200"), path)
    asked = vectors.where("vec_id % 50 = 0 or vec_id > 1480").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = lambda: {(r["query_id"], r["vec_id"]) for r in retrieval.nearest(asked, store.vectors(spark, path), 5).collect()}
    found = lambda: {(r["query_id"], r["vec_id"]) for r in store.search(asked, path, 5).collect()}
    assert found() == exact()  # no checkpoint yet: all are compared
    store.checkpoint(spark, path, k=5)
    write(vectors.where("vec_id >= 1200"), path)
    write(rows(spark, [0, 50], deleted=True), path)
    got, want = found(), exact()
    assert len(got & want) >= 0.9 * len(want) and not any(v in (0, 50) for _, v in got)
    assert {(i, i) for i in range(1481, 1500)} <= got


def test_awkward_rows(spark, path):
    write(spark.createDataFrame([(None, [1.0], False), (1, None, False), (2, [], None), (3, [1.0, 0.0], False), (3, [2.0, 0.0], False), (4, [1.0, 0.0, 0.0], False)], SCHEMA), path)
    assert {r["vec_id"]: r["embedding"] for r in store.vectors(spark, path).collect()} == {1: None, 2: [], 3: [2.0, 0.0], 4: [1.0, 0.0, 0.0]}
    store.checkpoint(spark, path)
    assert {r["vec_id"] for r in store.vectors(spark, path).collect()} == {1, 2, 3, 4}
    assert held_empty(spark)


def held_empty(spark):
    return store.vectors(spark, f"{shared_dir(spark)}/absent-{uuid.uuid4().hex}").count() == 0
