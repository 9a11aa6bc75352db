"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts up to ``chunk_chars`` code points are encoded in one go.  Longer ones are
cut into chunks that overlap by ``overlap`` code points, and the chunks spread
over the cluster.  Each chunk is pre-tokenised on its own; its first boundaries
may be wrong, because it starts inside a pre-token.  Pre-token matching looks
only forward, so as soon as two neighbours share a boundary in their overlap
they agree from there on: they are stitched at the first shared boundary.  Where
none is shared (one pre-token covers the overlap) the neighbours become one
piece.  Pieces are encoded in parallel and their ids concatenated.

A shared boundary counts only after a character that is no white space: a piece
that ended in white space could match ``\\s+(?!\\S)`` at its end where the whole
text does not.

Decoding concatenates the bytes of the ids.  ``round_trip`` encodes and decodes a
text, or a piece of a long one, in the same Python pass.  The ranks travel to the
executors as one broadcast of the vocabulary file, whose size the vocabulary fixes.

Defined cases: null and empty texts have no ids; control strings in texts are
ordinary text; repeated rows and null ids are kept as they are; other columns are
returned unless their name clashes with the result's.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded, small_batches, stage

CHUNK_CHARS = 32_768
OVERLAP = 512


@functools.lru_cache(maxsize=2)
def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def _pieces(pattern: str):
    return regex.compile(pattern)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _encoder(vocabulary, pattern: str, text_at: int, keep: list[int], decoded: bool):
    """A mapInArrow function: the columns at ``keep``, then the ids of the text, then the bytes that they decode to."""

    def run(batches):
        encoding = _encoding(vocabulary.value, pattern)
        for batch in batches:
            ids = [np.asarray(encoding.encode_ordinary(t) if t else [], np.int32) for t in batch.column(text_at).to_pylist()]
            columns = {"ids": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))}
            if decoded:
                columns["decoded"] = pa.array([encoding.decode_bytes(x.tolist()) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *columns.values()], names=[*(batch.schema.names[i] for i in keep), *columns])

    return bounded(run)


def _map_ids(rows: DataFrame, text_col: str, vocabulary, pattern: str, decoded: bool) -> DataFrame:
    """``rows`` with ``text_col`` replaced by ``ids``, and ``decoded`` if asked for."""
    keep = [f for f in rows.schema.fields if f.name != text_col]
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.BinaryType())] if decoded else [])]
    at = [i for i, f in enumerate(rows.schema.fields) if f.name != text_col]
    return rows.mapInArrow(_encoder(vocabulary, pattern, rows.columns.index(text_col), at, decoded), T.StructType([*keep, *more]))


def chunks(rows: DataFrame, text_col: str, chunk_chars: int, overlap: int) -> DataFrame:
    """One row per chunk of each text: the columns but the text, then chunk, low, part.

    ``part`` is the text from ``low`` to the end of the chunk; ``low`` lies
    ``overlap`` before the chunk's own start, but for the first.
    """
    n = F.expr(f"cast((char_length(`{text_col}`) + {chunk_chars - 1}) div {chunk_chars} as int)")
    out = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    out = out.withColumn("low", F.greatest(F.lit(0), F.col("chunk") * chunk_chars - overlap))
    return out.withColumn("part", F.expr(f"substring(`{text_col}`, low + 1, (chunk + 1) * {chunk_chars} - low)")).drop(text_col)


def _boundaries(pattern: str, chunk_chars: int, overlap: int):
    """Adds head and tail: boundaries inside the overlap with the chunk before and after."""

    def run(batches):
        find = _pieces(pattern).finditer
        for batch in batches:
            heads, tails = [], []
            columns = {f.name: i for i, f in enumerate(batch.schema)}
            for chunk, low, part in zip(*(batch.column(columns[c]).to_pylist() for c in ("chunk", "low", "part")), strict=True):
                starts = [m.start() for m in find(part)]
                good = [low + s for s in starts if s and not part[s - 1].isspace()]
                own, last = chunk * chunk_chars, (chunk + 1) * chunk_chars - overlap
                heads.append([s for s in good if s <= own] if chunk else [])
                tails.append([s for s in good if s >= last])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(columns[c]) for c in ("row", "chunk")] + [pa.array(heads, kind), pa.array(tails, kind)], names=["row", "chunk", "head", "tail"])

    return bounded(run)


def stitched(parts: DataFrame, pattern: str, chunk_chars: int, overlap: int) -> DataFrame:
    """(row, piece, text): whole texts cut where neighbouring chunks agree."""
    bounds = parts.mapInArrow(_boundaries(pattern, chunk_chars, overlap), "row long, chunk int, head array<int>, tail array<int>")
    order = Window.partitionBy("row").orderBy("chunk")
    shared = lambda a, b: F.array_min(F.array_intersect(a, b))
    edges = bounds.select(
        "row", "chunk", shared(F.lag("tail").over(order), F.col("head")).alias("from_"), shared(F.col("tail"), F.lead("head").over(order)).alias("to_")
    )
    edges = edges.withColumn("piece", F.sum(F.col("from_").isNotNull().cast("int")).over(order))
    cut = parts.join(edges, ["row", "chunk"]).withColumn("begin", F.coalesce("from_", F.col("chunk") * chunk_chars))
    cut = cut.withColumn("own", F.expr(f"substring(part, begin - low + 1, coalesce(to_, (chunk + 1) * {chunk_chars}) - begin)"))
    joined = cut.groupBy("row", "piece").agg(F.array_sort(F.collect_list(F.struct("chunk", "own"))).alias("owns"))
    return joined.select("row", "piece", F.array_join("owns.own", "").alias("text"))


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) in place of the text column."""
    return _encoded(docs, vocabulary_path, pattern, text_col, chunk_chars, overlap, False)


def round_trip(docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, the bytes of those ids (binary), in place of the text column."""
    return _encoded(docs, vocabulary_path, pattern, text_col, chunk_chars, overlap, True)


def _encoded(docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str, chunk_chars: int, overlap: int, decoded: bool) -> DataFrame:
    spark = small_batches(docs.sparkSession)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    made = ["ids", "decoded"][: 1 + decoded]
    docs = docs.drop(*(c for c in docs.columns if c.lower() in made and c != text_col))
    size = F.coalesce(F.char_length(F.col(text_col)), F.lit(0))
    short = _map_ids(docs.where(size <= chunk_chars), text_col, vocabulary, pattern, decoded)

    rest = [c for c in docs.columns if c != text_col]
    numbered = docs.where(size > chunk_chars).select(F.monotonically_increasing_id().alias("row"), F.struct(*rest).alias("rest") if rest else F.lit(1).alias("rest"), F.col(text_col).alias("text"))
    parts = stage(chunks(numbered, "text", chunk_chars, overlap).repartition("row", "chunk"), "bpe-chunks")
    pieces = stitched(parts.drop("rest"), pattern, chunk_chars, overlap)
    ids = _map_ids(pieces, "text", vocabulary, pattern, decoded)
    own = F.array_sort(F.collect_list(F.struct("piece", *made)))
    whole = ids.groupBy("row").agg(own.alias("own")).select("row", F.flatten("own.ids").alias("ids"), *([F.unhex(F.array_join(F.transform("own.decoded", F.hex), "")).alias("decoded")] if decoded else []))
    long = parts.where("chunk = 0").select("row", "rest").join(whole, "row").select(*(F.col("rest")[c].alias(c) for c in rest), *made)
    return short.select(*rest, *made).unionByName(long)


def decode(rows: DataFrame, vocabulary_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the decoded bytes (binary) in ``out_col``; null ids decode to null."""
    spark = small_batches(rows.sparkSession)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    rows = rows.drop(out_col)
    at = rows.columns.index(ids_col)

    def run(batches):
        decode_bytes = _encoding(vocabulary.value, pattern).decode_bytes
        for batch in batches:
            raw = [None if x is None else decode_bytes(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, out_col])

    return rows.mapInArrow(bounded(run), T.StructType([*rows.schema.fields, T.StructField(out_col, T.BinaryType())]))
