"""A vector store that batches and streams write to, with commits, a journal and checkpoints.

A store is a folder that the driver and all executors share.  Every task of a write
puts its rows into one file of the journal, each with the list of the inverted-file
index it belongs to; nothing reads that file until the driver, when all tasks are
done, names it in a commit, one file made at once.  A write that fails or is killed before leaves
no row, and an abort removes its files.  A stream's batch has one commit of
its own name, so a batch that is run again is not written twice.

A checkpoint folds the journal into the base: the newest row of every vector, deleted
ones left out, by list.  It chooses the centres of the lists anew and counts how many
lists a search must probe.  A search reads the probed lists of the base and of the
journal together, so it sees what is committed at once.

Rows are (vec_id long, embedding array<float>, deleted boolean); a null id is left
out, and of one id the last commit counts, in one commit a deletion, else the largest
embedding.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from ..operators import retrieval
from ..operators.staging import small, stage

SCHEMA = "vec_id long, embedding array<float>, deleted boolean"
_JOURNAL = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("deleted", pa.bool_()), ("list", pa.int32())])


def _local(path: str) -> str:
    """The folder as the shared file system mounts it."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"a vector store lies in a mounted folder, not in {parts.scheme}")
    return parts.path


def _put(path: str, content: bytes) -> bool:
    """Make a file whole or not at all; False if it is there already."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as out:
        out.write(content)
        out.flush()
        os.fsync(out.fileno())
    try:
        os.link(own, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(own)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class _Writer:
    """What batches and streams share: a file a task, a commit or an abort by the driver."""

    def __init__(self, path: str):
        self.path = _local(path)
        for folder in ("journal", "commits", "checkpoints"):
            os.makedirs(f"{self.path}/{folder}", exist_ok=True)
        state = current(path)
        self.centres = None if state is None else state["centres"]

    def write(self, batches) -> Written:
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        means = None if self.centres is None else np.array(self.centres)
        try:
            for batch in batches:
                table = pa.Table.from_batches([batch]).select(["vec_id", "embedding", "deleted"])
                table = table.filter(table.column("vec_id").is_valid())
                table = table.append_column("list", pa.array(_lists(table.column("embedding").combine_chunks(), means), pa.int32())).cast(_JOURNAL)
                out = out or pq.ParquetWriter(f"{self.path}/journal/{name}", _JOURNAL, compression="zstd")
                out.write_table(table)
                rows += table.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else "", rows)

    def _abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.file and os.path.exists(f"{self.path}/journal/{m.file}"):
                os.unlink(f"{self.path}/journal/{m.file}")

    def _commit(self, messages, name: str | None) -> None:
        """Name the files; the next free number orders commits, a stream's batch is looked for under its own name first."""
        done = os.listdir(f"{self.path}/commits")
        if name and any(c.endswith(f"-{name}.json") for c in done):
            return self._abort(messages)
        content = json.dumps([m.file for m in messages if m is not None and m.rows]).encode()
        number = 1 + max((int(c.split("-")[0]) for c in done if c.endswith(".json")), default=0)
        while not _put(f"{self.path}/commits/{number:012}.lock", b""):
            number += 1
        _put(f"{self.path}/commits/{number:012}-{name or uuid.uuid4().hex}.json", content)


def _lists(column: pa.ListArray, means: np.ndarray | None) -> np.ndarray:
    """The nearest centre of each vector; 0 without centres or for another size."""
    out = np.zeros(len(column), np.int32)
    if means is not None and len(column):
        good, rows = retrieval._matrix(column, means.shape[1])
        out[good] = (retrieval._unit(rows) @ means.T).argmax(axis=1)
    return out


class VectorWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages):
        self._commit(messages, None)

    def abort(self, messages):
        self._abort(messages)


class VectorStreamWriter(_Writer, DataSourceStreamArrowWriter):
    """``stream`` names the stream, so that several may write to one store."""

    def __init__(self, path: str, stream: str):
        super().__init__(path)
        self.stream = stream

    def commit(self, messages, batchId):
        self._commit(messages, f"{self.stream}-{batchId}")

    def abort(self, messages, batchId):
        self._abort(messages)


class VectorStore(DataSource):
    """``df.write.format("vector_store").option("path", ...).mode("append").save()`` and the same for streams."""

    @classmethod
    def name(cls):
        return "vector_store"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a vector store is appended to; write deletions to take vectors out")
        return VectorWriter(self.options["path"])

    def streamWriter(self, schema, overwrite):
        return VectorStreamWriter(self.options["path"], self.options.get("stream", "stream"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorStore)


# Reading


def current(path: str) -> dict | None:
    """The newest checkpoint: number of the last commit in it, folder, centres, probes."""
    folder = f"{_local(path)}/checkpoints"
    done = sorted(n for n in (os.listdir(folder) if os.path.isdir(folder) else []) if n.endswith(".json"))
    if not done:
        return None
    with open(f"{folder}/{done[-1]}") as file:
        return json.load(file)


def _journal(spark: SparkSession, path: str, after: int) -> tuple[DataFrame, int]:
    """The newest row of every vector in the commits after a number, and the last number."""
    folder, files, last = _local(path), [], after
    for name in sorted(n for n in (os.listdir(f"{folder}/commits") if os.path.isdir(f"{folder}/commits") else []) if n.endswith(".json")):
        number = int(name.split("-")[0])
        if number > after:
            with open(f"{folder}/commits/{name}") as file:
                files += [(number, f) for f in json.load(file)]
            last = max(last, number)
    schema = SCHEMA + ", list int"
    if not files:
        return spark.createDataFrame([], schema), last
    rows = spark.read.schema(schema).parquet(*(f"file://{folder}/journal/{f}" for _, f in files))
    order = spark.createDataFrame([(f, n) for n, f in files], "file string, commit long")
    rows = rows.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).join(small(order), "file")
    newest = F.max_by(F.struct("embedding", "deleted", "list"), F.struct("commit", F.coalesce("deleted", F.lit(False)).alias("d"), "embedding"))
    return rows.groupBy("vec_id").agg(newest.alias("r")).select("vec_id", "r.embedding", F.coalesce("r.deleted", F.lit(False)).alias("deleted"), "r.list"), last


def _base(spark: SparkSession, path: str, state: dict) -> DataFrame:
    return spark.read.schema("vec_id long, embedding array<float>, list int").parquet(f"file://{_local(path)}/{state['folder']}")


def _placed(spark: SparkSession, path: str) -> tuple[DataFrame, dict | None, int]:
    """(vec_id, embedding, list) of all committed vectors: the base less what the journal replaces, and the journal."""
    state = current(path)
    recent, last = _journal(spark, path, state["commit"] if state else 0)
    recent = stage(recent, "vector-journal")
    live = recent.where("not deleted").select("vec_id", "embedding", "list")
    if state is None:
        return live, None, last
    kept = _base(spark, path, state).join(small(recent.select("vec_id")), "vec_id", "left_anti")
    return kept.unionByName(live), state, last


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding) of all committed vectors."""
    return _placed(spark, path)[0].select("vec_id", "embedding")


def search(queries: DataFrame, path: str, k: int = 10) -> DataFrame:
    """The k nearest of every query (query_id, query): through the index once there is a checkpoint, else among all vectors."""
    spark = queries.sparkSession
    placed, state, _ = _placed(spark, path)
    if state is None or not state["centres"]:
        return retrieval.nearest(queries, placed.select("vec_id", "embedding"), k)
    means = spark.sparkContext.broadcast(np.array(state["centres"]))
    return retrieval.nearest_in_lists(queries, placed, means, state["probes"], k)


def checkpoint(spark: SparkSession, path: str, k: int = 10, recall: float = 0.97, lists: int | None = None) -> None:
    """Fold the journal into a new base.  Commits made meanwhile stay in the journal; a failed fold leaves the old base."""
    placed, _, last = _placed(spark, path)
    rows = stage(placed.select("vec_id", "embedding"), "vector-base")
    n = rows.count()
    centres, probes = retrieval.centres(rows, lists or max(4, min(4096, round(n**0.5 / 4))), k, recall) if n else (np.zeros((0, 0)), 1)
    folder = f"base-{uuid.uuid4().hex}"
    own = retrieval.place_in_lists(rows, spark.sparkContext.broadcast(centres)) if n else rows.withColumn("list", F.lit(0))
    # vectors of another size have no list and are found by a full scan only; they stay in list 0
    own = rows.join(own.select("vec_id", "list"), "vec_id", "left").select("vec_id", "embedding", F.coalesce("list", F.lit(0)).alias("list"))
    own.sortWithinPartitions("list").write.parquet(f"file://{_local(path)}/{folder}")
    _put(f"{_local(path)}/checkpoints/{last:012}-{uuid.uuid4().hex}.json", json.dumps({"commit": last, "folder": folder, "centres": centres.tolist(), "probes": probes}).encode())
