"""Late interaction: texts and queries as matrices of token vectors, scored by the sum of best matches.

A document's score is the sum, over the query's token vectors, of the largest dot
product with any of the document's.  :func:`maxsim` scores given candidates exactly, to rerank them.
:func:`search` looks at all documents through product-quantised codes, one byte for
each part of a token vector instead of its floats, and scores the best of them exactly.

Defined cases: a document without token vectors scores 0, as does a query without; vectors
of another size than asked for are left out; equal scores keep the candidates' order, then
the document's id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import small, stage

#: Token vectors that codebooks are learned from, entries of a codebook, queries that one pass over the codes asks.
SAMPLE, ENTRIES, QUERIES = 20_000, 256, 256
#: Of the documents that the codes rank best, so many times ``top`` are scored exactly.
AGAIN = 8


def matrices(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(token vectors of all rows, how many each row has)."""
    flat = column.flatten()
    counts = np.diff(column.offsets.to_numpy())
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size), np.where(column.is_valid().to_numpy(zero_copy_only=False), counts, 0)


def usable(vectors: Column, size: int) -> Column:
    """The token vectors of that size; none for null."""
    return F.filter(F.coalesce(vectors, F.array().cast("array<array<float>>")), lambda v: F.size(v) == size)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def maxsim(queries: DataFrame, candidates: DataFrame, documents: DataFrame, size: int, top: int = 10) -> DataFrame:
    """(query_id, doc_id, score, place): the ``top`` of each query's candidates (query_id, doc_id, place) by their exact score."""
    asked = queries.select("query_id", usable(F.col("vectors"), size).alias("q"))
    given = documents.select("doc_id", usable(F.col("vectors"), size).alias("d"))
    pairs = candidates.select("query_id", "doc_id", F.col("place").cast("int").alias("before")).join(asked, "query_id").join(given, "doc_id").select("query_id", "doc_id", "before", "q", "d")

    def run(batches):
        for batch in batches:
            (q, nq), (d, nd) = (matrices(batch.column(k), size) for k in (3, 4))
            q_at, d_at = np.r_[0, np.cumsum(nq)], np.r_[0, np.cumsum(nd)]
            scores = np.zeros(batch.num_rows)
            for k in range(batch.num_rows):
                if nq[k] and nd[k]:
                    scores[k] = (q[q_at[k] : q_at[k + 1]] @ d[d_at[k] : d_at[k + 1]].T).max(axis=1).sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.round(scores, 6))], names=["query_id", "doc_id", "before", "score"])

    scored = pairs.mapInArrow(run, f"query_id {_kind(queries, 'query_id')}, doc_id {_kind(documents, 'doc_id')}, before int, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "before", "doc_id"))
    return scored.withColumn("place", place).where(F.col("place") <= top).select("query_id", "doc_id", "score", "place")


@dataclass
class Codebooks:
    """(parts, entries, size / parts): the centres that each part of a token vector is replaced by."""

    entries: np.ndarray

    @property
    def size(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def encode(self, rows: np.ndarray) -> np.ndarray:
        """(rows, parts) numbers of the nearest entries."""
        parts, _, width = self.entries.shape
        out = np.empty((len(rows), parts), np.uint8)
        for low in range(0, len(rows), 8192):
            part = rows[low : low + 8192].reshape(-1, parts, width)
            for p in range(parts):
                gap = (self.entries[p] ** 2).sum(axis=1) - 2 * part[:, p] @ self.entries[p].T
                out[low : low + 8192, p] = gap.argmin(axis=1)
        return out


def learn(documents: DataFrame, size: int, parts: int, sample: int = SAMPLE, rounds: int = 10, seed: int = 42) -> Codebooks | None:
    """Codebooks by k-means over at most ``sample`` token vectors, those of the least hash; none without vectors."""
    tokens = documents.select(F.explode(usable(F.col("vectors"), size)).alias("v"))
    rows = np.array([r["v"] for r in tokens.orderBy(F.xxhash64("v")).limit(sample).collect()], np.float64)
    if not len(rows):
        return None
    rng, width = np.random.default_rng(seed), size // parts
    books = np.empty((parts, min(ENTRIES, len(rows)), width))
    for p in range(parts):
        points = rows[:, p * width : (p + 1) * width]
        centres = points[rng.choice(len(points), books.shape[1], replace=False)]
        for _ in range(rounds):
            own = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
            total, count = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
            np.add.at(total, own, points)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        books[p] = centres
    return Codebooks(books)


def codes(documents: DataFrame, books: Codebooks) -> DataFrame:
    """(doc_id, codes): the token vectors of each document as one byte a part."""
    shared = documents.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            rows, counts = matrices(batch.column(1), shared.value.size)
            found, at = shared.value.encode(rows), np.r_[0, np.cumsum(counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([found[at[k] : at[k + 1]].tobytes() for k in range(batch.num_rows)], pa.binary())], names=["doc_id", "codes"])

    return documents.select("doc_id", usable(F.col("vectors"), books.size).alias("v")).mapInArrow(run, f"doc_id {_kind(documents, 'doc_id')}, codes binary")


def _ranked(shared, top: int):
    """The best of a task's documents for each query, by their codes."""

    def run(batches):
        names, counts, tables = shared.value
        edges, parts = np.r_[0, np.cumsum(counts)[:-1]], tables.shape[1]
        best = None
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) // parts if x.is_valid else 0 for x in batch.column(1)], np.int64)
            full = np.flatnonzero(sizes)
            for low in range(0, len(full), 64):
                rows = full[low : low + 64]
                code = np.frombuffer(b"".join(batch.column(1)[int(k)].as_py() for k in rows), np.uint8).reshape(-1, parts)
                near = sum(tables[:, p, :][:, code[:, p]] for p in range(parts))
                score = np.add.reduceat(np.maximum.reduceat(near, np.r_[0, np.cumsum(sizes[rows])[:-1]], axis=1), edges, axis=0)
                query = np.repeat(np.arange(len(score)), score.shape[1])
                ids = np.array([batch.column(0)[int(k)].as_py() for k in rows], object)
                found = (query, score.ravel(), np.tile(ids, len(score)))
                best = found if best is None else tuple(np.concatenate(pair) for pair in zip(best, found, strict=True))
                if len(best[0]) > 50_000 + 4 * top * len(score):
                    best = _keep(*best, top)
        if best is not None:
            query, score, ids = _keep(*best, top)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(ids.tolist(), batch.schema.field(0).type), pa.array(score)], names=["query_id", "doc_id", "near"])

    return run


def _keep(query: np.ndarray, score: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((-score, query))
    query, score, ids = query[order], score[order], ids[order]
    first = np.arange(len(query)) - np.searchsorted(query, query) < top
    return query[first], score[first], ids[first]


def search(queries: DataFrame, documents: DataFrame, encoded: DataFrame, books: Codebooks, top: int = 10, again: int = AGAIN) -> DataFrame:
    """(query_id, doc_id, score, place): ``maxsim`` of the ``again * top`` documents that their codes rank best for each query."""
    asked = stage(queries.select("query_id", usable(F.col("vectors"), books.size).alias("q")).where(F.size("q") > 0), "late-queries")
    parts, width = books.entries.shape[0], books.entries.shape[2]
    schema = f"query_id {_kind(queries, 'query_id')}, doc_id {_kind(documents, 'doc_id')}, near double"
    blocks, found = max(1, -(-asked.count() // QUERIES)), None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        if not own.num_rows:
            continue
        rows, counts = matrices(own.column("q").combine_chunks(), books.size)
        tables = np.stack([rows[:, p * width : (p + 1) * width] @ books.entries[p].T for p in range(parts)], axis=1)
        shared = queries.sparkSession.sparkContext.broadcast((own.column("query_id").combine_chunks(), counts, tables))
        part = encoded.select("doc_id", "codes").mapInArrow(_ranked(shared, top * again), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.sparkSession.createDataFrame([], f"query_id {_kind(queries, 'query_id')}, doc_id {_kind(documents, 'doc_id')}, score double, place int")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "doc_id"))
    # the codes choose the candidates only: equal exact scores are told apart by id
    chosen = stage(found.withColumn("place", place).where(F.col("place") <= top * again).select("query_id", "doc_id", F.lit(0).alias("place")), "late-candidates")
    few = documents.join(small(stage(chosen.select("doc_id").distinct(), "late-documents")), "doc_id", "left_semi")
    return maxsim(queries, chosen, few, books.size, top)
