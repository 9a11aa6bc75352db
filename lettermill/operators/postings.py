"""A keyword index that persists: compressed postings in blocks of documents, read only where a result can lie.

An index is a folder.  Documents are added in segments; a version names the segments
that belong to it and is written last, so a failed addition leaves the index as it
was, and merging makes one segment of all.  In a segment, documents are sorted (by
length, which is what BM25 rewards) and dealt to blocks of ``SLOTS``.  A posting row
is one term in one block: its documents as slots, a bitmap where there are many, else two bytes each, and the
least and largest value that decides a score.

A search is in three steps.  Headers of the terms' postings alone, a few columns that
Parquet prunes by term, give every (query, block) the most that a document there can
score.  The best blocks of each query are read and scored, which gives a score that
its last place cannot fall below.  Only blocks whose bound reaches that score are read
then; the rest cannot change the result, which is exact.  How many blocks there were
and how many were read comes with it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .retrieval import EPSILON, K1, B
from .staging import stage

SLOTS = 4096
#: Documents sorted in one task; blocks of a query that are scored first; queries for which a block is read once.
ROWS_PER_TASK, FIRST, TOGETHER = 100_000, 2, 256
_POSTING = "term string, block long, n int, low double, high double, slots binary, weights binary"


def encode(slots: np.ndarray) -> bytes:
    """Ascending slots of a block: a bitmap if that is shorter, else two bytes each."""
    if len(slots) * 2 < SLOTS // 8:
        return b"\x00" + slots.astype("<u2").tobytes()
    bits = np.zeros(SLOTS, np.uint8)
    bits[slots] = 1
    return b"\x01" + np.packbits(bits, bitorder="little").tobytes()


def decode(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return np.frombuffer(data, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little"))


def encode_all(slots: np.ndarray, edges: np.ndarray) -> pa.Array:
    """What ``encode`` gives for each run of slots that begins at an edge, without a call a run."""
    counts = np.diff(np.r_[edges, len(slots)])
    listed = counts * 2 < SLOTS // 8
    offsets = np.r_[0, np.cumsum(np.where(listed, 1 + 2 * counts, 1 + SLOTS // 8))]
    data = np.zeros(offsets[-1], np.uint8)
    data[offsets[:-1][~listed]] = 1
    each, start = np.repeat(listed, counts), np.repeat(offsets[:-1] + 1, counts)
    at = start[each] + 2 * (np.arange(len(slots)) - np.repeat(edges, counts))[each]
    data[at], data[at + 1] = slots[each] & 255, slots[each] >> 8
    np.bitwise_or.at(data, start[~each] + (slots[~each] >> 3), (1 << (slots[~each] & 7)).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def decode_all(coded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all runs in one array, and how many each run has."""
    if not len(coded):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(coded.buffers()[1], np.int32, len(coded) + 1, coded.offset * 4).astype(np.int64)
    data = np.frombuffer(coded.buffers()[2], np.uint8)
    listed = data[offsets[:-1]] == 0
    counts = (np.diff(offsets) - 1) // 2
    bits = np.unpackbits(data[offsets[:-1][~listed, None] + 1 + np.arange(SLOTS // 8)], axis=1, bitorder="little")
    counts[~listed] = bits.sum(axis=1)
    each = np.repeat(listed, counts)
    out, starts = np.zeros(len(each), np.int64), np.cumsum(counts) - counts
    at = (np.repeat(offsets[:-1] + 1, counts) + 2 * (np.arange(len(each)) - np.repeat(starts, counts)))[each]
    out[each] = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8
    out[~each] = np.nonzero(bits)[1]
    return out, counts


@dataclass
class Index:
    """The tables of one version: documents (block, keys, lengths), postings, and how many documents and how long on average."""

    documents: DataFrame
    postings: DataFrame
    size: int
    mean_length: float


def _segments(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The newest version and its segments; a version is a table of one row that Spark's commit makes visible at once."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return 0, []
    done = [int(f.getPath().getName()) for f in files.listStatus(folder) if files.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    if not done:
        return 0, []
    return max(done), json.loads(spark.read.text(f"{path}/versions/{max(done)}").first()["value"])


def _publish(spark: SparkSession, path: str, version: int, segments: list[str]) -> None:
    """Make ``segments`` the next version; it fails if another writer has made it."""
    spark.createDataFrame([(json.dumps(segments),)], "value string").coalesce(1).write.mode("error").text(f"{path}/versions/{version + 1}")


def _build(rows: DataFrame, path: str) -> str:
    """Write a segment of ``rows`` (key, length, cells: distinct terms with weights, or without) and name it."""
    name = uuid.uuid4().hex
    rows = stage(rows, "index-rows")
    parts = max(1, -(-rows.count() // ROWS_PER_TASK))
    sorted_ = rows.repartitionByRange(parts, "length", "key").sortWithinPartitions("length", "key")
    # the number of the partition stands in the high bits, the row's place in it in the low 33
    numbered = sorted_.select("key", "length", "cells", F.monotonically_increasing_id().alias("place"))
    part, place = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    placed = stage(numbered.select("key", "length", "cells", (F.shiftleft(part, 32) + F.floor(place / SLOTS)).alias("block"), (place % SLOTS).cast("int").alias("slot")), "index-placed")
    own = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slot", "key", "length"))).alias("d"))
    own.select("block", F.transform("d", lambda x: x["key"]).alias("keys"), F.transform("d", lambda x: x["length"]).alias("lengths")).write.parquet(f"{path}/segments/{name}/documents")

    def packed_rows(rows: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        slot, weight, length = (rows.column(c).to_numpy() for c in ("slot", "weight", "length"))
        weighted = ~np.logical_or.reduceat(np.isnan(weight), edges)
        value = np.where(np.repeat(weighted, np.diff(np.r_[edges, len(slot)])), weight, length)
        weights = pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer((np.r_[edges, len(slot)] * 8).astype(np.int32)), pa.py_buffer(weight.astype("<f8"))])
        first = rows.select(["term", "block"]).take(pa.array(edges)).combine_chunks()
        return pa.RecordBatch.from_arrays([
            first.column("term").chunk(0), first.column("block").chunk(0), pa.array(np.diff(np.r_[edges, len(slot)]), pa.int32()), pa.array(np.minimum.reduceat(value, edges)), pa.array(np.maximum.reduceat(value, edges)),
            encode_all(slot.astype(np.int64), edges), pc.if_else(pa.array(weighted), weights, pa.scalar(None, pa.binary())),
        ], names=["term", "block", "n", "low", "high", "slots", "weights"])

    def pack(batches):
        """One row for each run of a term and block in sorted cells; the last run of a batch may go on in the next."""
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            if not rows.num_rows:
                continue
            term, block = rows.column("term"), rows.column("block").to_numpy()
            new = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy() | (block[1:] != block[:-1])
            edges = np.flatnonzero(np.r_[True, new])
            if len(edges) > 1:
                yield packed_rows(rows.slice(0, edges[-1]), edges[:-1])
            rest = rows.slice(edges[-1])
        if rest is not None:
            yield packed_rows(rest, np.zeros(1, np.int64))

    # dealt by block before the cells are rows, so that a document travels as one
    cells = placed.repartition("block").select("block", "slot", "length", F.explode("cells").alias("c")).select("block", "slot", "length", F.col("c.term").alias("term"), F.coalesce("c.weight", F.lit(float("nan"))).alias("weight"))
    # sorted by term, so that a reader of a few terms skips row groups
    packed = cells.sortWithinPartitions("term", "block", "slot").mapInArrow(pack, _POSTING)
    packed.write.option("compression", "zstd").parquet(f"{path}/segments/{name}/postings")
    return name


def add(path: str, rows: DataFrame) -> None:
    """Add documents to the index at ``path`` as one segment: (key, cells: array of (term, weight)).

    A weight is null in an index for BM25, and positive in one for dot products: other
    cells are left out.  A term counts once a document.  Null keys are left out.
    """
    spark = rows.sparkSession
    usable = rows.where("key is not null").select("key", F.filter(F.coalesce("cells", F.array().cast(rows.schema["cells"].dataType)), lambda c: c["term"].isNotNull() & (c["weight"].isNull() | (c["weight"] > 0))).alias("cells"))
    version, segments = _segments(spark, path)
    _publish(spark, path, version, [*segments, _build(usable.select("key", F.size("cells").alias("length"), "cells"), path)])


def merge(spark: SparkSession, path: str) -> None:
    """Make one segment of all: their rows are unpacked, sorted again and packed into full blocks."""
    version, segments = _segments(spark, path)
    if len(segments) < 2:
        return
    index = _open(spark, path, segments)

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                slots = decode(row["slots"])
                weights = pa.array(np.frombuffer(row["weights"], "<f8")) if row["weights"] is not None else pa.nulls(len(slots), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([row["segment"]] * len(slots), pa.int32()), pa.array([row["block"]] * len(slots), pa.int64()), pa.array(slots.astype(np.int32)), pa.array([row["term"]] * len(slots), pa.string()), weights], names=["segment", "block", "slot", "term", "weight"])

    cells = index.postings.select("segment", "block", "term", "slots", "weights").mapInArrow(unpack, "segment int, block long, slot int, term string, weight double")
    cells = cells.groupBy("segment", "block", "slot").agg(F.collect_list(F.struct("term", "weight")).alias("cells"))
    keys = index.documents.select("segment", "block", F.posexplode(F.arrays_zip("keys", "lengths")).alias("slot", "d")).select("segment", "block", "slot", "d.*")
    none = F.array().cast("array<struct<term:string,weight:double>>")
    rows = keys.join(cells, ["segment", "block", "slot"], "left").select(F.col("keys").alias("key"), F.col("lengths").alias("length"), F.coalesce("cells", none).alias("cells"))
    _publish(spark, path, version, [_build(rows, path)])


def _open(spark: SparkSession, path: str, segments: list[str]) -> Index:
    def union(kind: str) -> DataFrame:
        out = None
        for number, name in enumerate(segments):
            own = spark.read.parquet(f"{path}/segments/{name}/{kind}").withColumn("segment", F.lit(number))
            out = own if out is None else out.unionByName(own)
        return out

    documents = union("documents")
    size = documents.agg(F.sum(F.size("keys")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("l")).first()
    return Index(documents, union("postings"), size["n"] or 0, (size["l"] or 0) / max(1, size["n"] or 0))


def open_index(spark: SparkSession, path: str) -> Index | None:
    """The newest version; none where nothing was added."""
    _, segments = _segments(spark, path)
    return _open(spark, path, segments) if segments else None


def idf(index: Index) -> tuple[DataFrame, Column]:
    """(term, idf) of the vocabulary from the postings' headers, a negative idf replaced by EPSILON times the mean."""
    frequency = index.postings.groupBy("term").agg(F.sum("n").alias("df"))
    raw = frequency.select("term", (F.log(F.lit(index.size) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf")).first()[0]
    return raw.select("term", F.when(F.col("idf") < 0, F.lit((mean or 0.0) * EPSILON)).otherwise(F.col("idf")).alias("idf")), F.lit(mean)


def _impact(length, mean: float):
    """What a term counts in a document of that many terms, before its idf."""
    return (K1 + 1) / (1 + K1 * (1 - B + B * length / max(mean, 1e-9)))


@dataclass
class Found:
    """(query_id, key, score, place, raw: whether a raw term is among what matched), and (query_id, blocks, read)."""

    hits: DataFrame
    blocks: DataFrame


def _asking(headers: DataFrame, asked: DataFrame, chosen: DataFrame, group: list[str]) -> DataFrame:
    """(term, group..., asking: which queries with what factors): only terms that a chosen block has, as all terms for all blocks would grow with the square of the index."""
    there = headers.select("term", "segment", "block").join(chosen.select("segment", "block").distinct(), ["segment", "block"], "left_semi")
    return there.join(asked, "term").join(chosen, ["query_id", "segment", "block"]).groupBy("term", *group).agg(F.collect_list(F.struct("query_id", "factor", "raw")).alias("asking"))


def search(index: Index, asked: DataFrame, top: int, bm25: bool) -> Found:
    """The ``top`` documents of every query by score, then key; ``asked`` is (query_id, term, factor, raw).

    A score is the sum over the query's terms of the factor times the document's weight,
    or times BM25's share for its length; only scores over 0 count, rounded to 6 places.
    """
    query_kind, mean = asked.schema["query_id"].dataType.simpleString(), index.mean_length
    key_kind = index.documents.schema["keys"].dataType.elementType.simpleString()
    asked = stage(asked.where("factor <> 0"), "index-asked")
    headers = index.postings.select("term", "segment", "block", "low", "high").join(F.broadcast(asked.select("term").distinct()) if asked.count() <= 100_000 else asked.select("term").distinct(), "term", "left_semi")
    most = _impact(F.col("low"), mean) if bm25 else F.col("high")
    # a document may lack what would lower its score
    bound = F.sum(F.when(F.col("factor") > 0, F.col("factor") * most).otherwise(0.0))
    bounds = stage(headers.join(asked, "term").groupBy("query_id", "segment", "block").agg(bound.alias("bound")).where("bound > 0"), "index-bounds")

    def score(key, postings: pa.Table, documents: pa.Table) -> pa.Table:
        """The best of a block for each query of a batch; the block's postings are read once for all of them."""
        found = []
        if postings.num_rows and documents.num_rows:
            names = documents.column("keys")[0].values
            length = documents.column("lengths")[0].values.to_numpy()
            # summed in the order of the terms, so that equal documents have equal scores
            postings = postings.take(pc.sort_indices(postings.column("term"))).combine_chunks()
            slots, sizes = decode_all(postings.column("slots").chunk(0))
            starts = np.cumsum(sizes) - sizes
            value = _impact(length[slots], mean) if bm25 else np.frombuffer(b"".join(postings.column("weights").to_pylist()), "<f8")
            asking = postings.column("asking").chunk(0)
            row = np.repeat(np.arange(len(asking)), np.diff(asking.offsets.to_numpy()))
            each = asking.flatten()
            query = each.field("query_id").dictionary_encode()
            code, factor, raw = query.indices.to_numpy(), each.field("factor").to_numpy(), each.field("raw").to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            edges = np.searchsorted(code[order], np.arange(len(query.dictionary) + 1))
            for k in range(len(query.dictionary)):
                own = order[edges[k] : edges[k + 1]]
                n = sizes[row[own]]
                at = np.repeat(starts[row[own]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                total = np.round(np.bincount(slots[at], np.repeat(factor[own], n) * value[at], SLOTS), 6)
                hit = np.flatnonzero(total > 0)
                if len(hit) > top:
                    hit = hit[total[hit] >= np.partition(total[hit], -top)[-top]]
                is_raw = np.bincount(slots[at][np.repeat(raw[own], n)], minlength=SLOTS) > 0
                found.append(pa.table({"query_id": query.dictionary.take(pa.array([k] * len(hit), pa.int64())), "key": names.take(pa.array(hit)), "score": pa.array(total[hit]), "raw": pa.array(is_raw[hit])}))
        kind = pa.schema([("query_id", asked_type), ("key", key_type), ("score", pa.float64()), ("raw", pa.bool_())])
        return pa.concat_tables([t.cast(kind) for t in found]) if found else kind.empty_table()

    from pyspark.sql.pandas.types import to_arrow_type

    asked_type, key_type = to_arrow_type(asked.schema["query_id"].dataType), to_arrow_type(index.documents.schema["keys"].dataType.elementType)
    queries = max(1, asked.select("query_id").distinct().count())
    terms = asked.select("term").distinct()
    terms = F.broadcast(terms) if terms.count() <= 100_000 else terms

    def read(chosen: DataFrame, name: str) -> DataFrame:
        """Scores of the chosen (query_id, segment, block)."""
        group = ["segment", "block", "share"]
        chosen = chosen.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(-(-queries // TOGETHER))).cast("int"))
        asking = _asking(headers, asked, chosen, group)
        own = index.postings.drop("n", "low", "high").join(terms, "term", "left_semi").join(asking, ["term", "segment", "block"])
        documents = index.documents.join(chosen.select(*group).distinct(), ["segment", "block"]).select(*(F.col(c).alias(f"{c}_") for c in group), "keys", "lengths")
        scored = own.groupBy(*group).cogroup(documents.groupBy(*(f"{c}_" for c in group))).applyInArrow(score, f"query_id {query_kind}, key {key_kind}, score double, raw boolean")
        return stage(scored, name)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block"))
    ranked = bounds.withColumn("rank", rank)
    first = read(stage(ranked.where(F.col("rank") <= FIRST).select("query_id", "segment", "block"), "index-first"), "index-scores")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    edge = first.withColumn("place", place).where(F.col("place") == top).select("query_id", F.col("score").alias("edge"))
    rest = stage(ranked.where(F.col("rank") > FIRST).join(edge, "query_id", "left").where(F.col("edge").isNull() | (F.round("bound", 6) + 1e-6 >= F.col("edge"))).select("query_id", "segment", "block"), "index-rest")
    both = first.unionByName(read(rest, "index-scores"))
    hits = both.withColumn("place", place).where(F.col("place") <= top)
    after = rest.groupBy("query_id").agg(F.count(F.lit(1)).alias("more"))
    blocks = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.count(F.when(F.col("rank") <= FIRST, 1)).alias("firsts"))
    return Found(hits, blocks.join(after, "query_id", "left").select("query_id", "blocks", (F.col("firsts") + F.coalesce("more", F.lit(0))).alias("read")))


def search_bm25(index: Index, terms: DataFrame, top: int) -> Found:
    """BM25 over distinct terms; ``terms`` is (query_id, term, raw)."""
    known, _ = idf(index)
    return search(index, terms.join(known, "term").select("query_id", "term", F.col("idf").alias("factor"), "raw"), top, True)


def search_dot(index: Index, weights: DataFrame, top: int) -> Found:
    """Dot products; ``weights`` is (query_id, term, factor), of which positive ones count."""
    return search(index, weights.where("factor > 0").select("query_id", "term", F.col("factor").cast("double").alias("factor"), F.lit(True).alias("raw")), top, False)
