"""Topics by non-negative matrix factorisation of the TF-IDF matrix.

Texts are rows of sparse weights over a vocabulary of real terms, words and pairs of
words, as many as asked for: those that occur most often in all texts.  V is close to
W H with W and H non-negative; a row of W holds a text's topics, a row of H a topic's
terms.

Each round updates both factors so that the squared error does not rise.  H, whose
size the vocabulary and the number of topics bound, is sent to the tasks; each task
updates the rows of W of its own texts and sums two small products of them, W'W and
W'V, which are added up in a tree and give the next H.  Rows of W never leave their
task: they follow from H, so nothing but H is kept between rounds and a lost executor
costs its texts only.  The start is that of NNDSVD with its zeros filled: the leading singular vectors of
V, found by the same kind of passes, each taken by the half of its signs that
carries more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

MOST_TERMS, ROUNDS, INNER, LEAST_FALL = 10_000, 60, 50, 1e-3
TINY, PIECE = 1e-12, 1 << 14


def words_of(text: Column, stop_words: list[str] | None = None) -> Column:
    """Words of two characters and more that are no stop words (English ones unless given)."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    stop_words = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    return F.filter(found, lambda w: ~w.isin(*stop_words))


def terms_of(words: Column) -> Column:
    """The words and the pairs of neighbours among them; as each is read several times, ``words`` should be a column of a staged table."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def matrix(rows: DataFrame, key: str, text: str, most_terms: int = MOST_TERMS, stop_words: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(key, cells: terms as numbers, weights: unit length) of the texts that have a term, and the vocabulary in order.

    Rows that share a key are one text.  A weight is (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), divided by the row's length.
    Texts are cut into words once; only the terms of the vocabulary are counted by text.
    """
    valid = rows.where(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0)
    words = stage(valid.select(key, words_of(F.col(text), stop_words).alias("words")), "topic-words")
    # the most frequent terms are numbered in order of their letters
    used = words.select(F.explode(terms_of(F.col("words"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "term").limit(most_terms).collect()
    vocabulary = sorted(r["term"] for r in used)
    numbers = rows.sparkSession.createDataFrame(list(zip(vocabulary, range(len(vocabulary)), strict=True)), "term string, cell int")
    cells = words.select(key, F.explode(terms_of(F.col("words"))).alias("term")).join(F.broadcast(numbers), "term").select(key, "cell")
    # dealt by key once, for both aggregations
    counted = cells.repartition(key).groupBy(key, "cell").agg(F.count(F.lit(1)).alias("tf")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("cell", "tf"))).alias("c"))
    counted = stage(counted.select(key, F.col("c.cell").alias("cells"), F.col("c.tf").alias("tfs")), "topic-counts")
    n, df = words.select(key).distinct().count(), np.zeros(len(vocabulary))
    for r in counted.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r["cell"]] = r["df"]
    idf = rows.sparkSession.sparkContext.broadcast(np.log((1 + n) / (1 + df)) + 1)

    def weigh(batches):
        for batch in batches:
            cells, tfs = batch.column(1), batch.column(2)
            sizes = np.diff(cells.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            weight = (1 + np.log(tfs.flatten().to_numpy())) * idf.value[cells.flatten().to_numpy()]
            weight /= np.sqrt(np.bincount(row, weight * weight, minlength=batch.num_rows))[row]
            offsets = pa.array(np.cumsum(np.r_[0, sizes]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), cells, pa.ListArray.from_arrays(offsets, pa.array(weight))], names=[key, "cells", "weights"])

    return stage(counted.mapInArrow(weigh, f"{key} {rows.schema[key].dataType.simpleString()}, cells array<int>, weights array<double>"), "topic-matrix"), vocabulary


def _blocks(batch: pa.RecordBatch, terms: int, most: int = 2048):
    """(low, dense rows) of a batch, a few at a time."""
    cells, weights = batch.column(1), batch.column(2)
    for low in range(0, batch.num_rows, most):
        own, worth = cells.slice(low, most), weights.slice(low, most)
        sizes = np.diff(own.offsets.to_numpy())
        yield np.repeat(np.arange(len(own)), sizes), own.flatten().to_numpy(), worth.flatten().to_numpy(), len(own)


def _times(row: np.ndarray, cell: np.ndarray, worth: np.ndarray, n: int, right: np.ndarray) -> np.ndarray:
    """The sparse block (n, terms) times ``right`` (terms, k)."""
    return np.stack([np.bincount(row, worth * column[cell], minlength=n) for column in np.ascontiguousarray(right.T)], axis=1)


def _transposed(row: np.ndarray, cell: np.ndarray, worth: np.ndarray, left: np.ndarray, terms: int) -> np.ndarray:
    """``left`` (n, k) transposed times the sparse block: (k, terms)."""
    return np.stack([np.bincount(cell, worth * left[row, j], minlength=terms) for j in range(left.shape[1])])


def _solve(target: np.ndarray, gram: np.ndarray, start: np.ndarray, rounds: int = INNER) -> np.ndarray:
    """Rows w >= 0 that bring |v - w H|^2 down, one topic after another, each to its exact best; ``target`` is v H'."""
    w = start.copy()
    for _ in range(rounds):
        before = w.copy()
        for j in range(gram.shape[0]):
            w[:, j] = np.maximum(0.0, w[:, j] + (target[:, j] - w @ gram[:, j]) / max(gram[j, j], TINY))
        if np.abs(w - before).max(initial=0.0) < 1e-7:
            break
    return w


def _lists(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow array of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).ravel()))


def _add(table: pa.Table) -> pa.Table:
    rows = table.column("x").combine_chunks()
    total = rows.flatten().to_numpy().reshape(len(rows), -1).sum(axis=0)
    return pa.table({"k": table.column("k").slice(0, 1), "piece": table.column("piece").slice(0, 1), "x": _lists(total[None])})


def _summed(data: DataFrame, work) -> list[np.ndarray]:
    """The element-wise sums of the arrays that ``work(batch)`` gives, added in each task and then in a tree.

    An array travels in pieces of fixed size, and no task adds more than about the
    root of the number of tasks of them.
    """

    def run(batches):
        total = None
        for batch in batches:
            for found in work(batch):
                total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        for k, x in enumerate(total or []):
            flat = np.asarray(x, np.float64).ravel()
            padded = np.zeros(-(-max(1, len(flat)) // PIECE) * PIECE) if len(flat) > PIECE else np.zeros(max(1, len(flat)))
            padded[: len(flat)] = flat
            pieces = padded.reshape(-1, min(PIECE, len(padded)))
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()), _lists(pieces)], names=["k", "piece", "x"])

    out = "k int, piece int, x array<double>"
    tasks = data.rdd.getNumPartitions()
    sums = data.mapInArrow(run, out)
    if tasks > 64:
        sums = sums.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(round(tasks**0.5)))).groupBy("k", "piece", "part").applyInArrow(_add, out)
    found = sorted((r["k"], r["piece"], r["x"]) for r in sums.groupBy("k", "piece").applyInArrow(_add, out).collect())
    return [np.concatenate([x for own, _, x in found if own == k]) for k in sorted({k for k, _, _ in found})]


def singular(data: DataFrame, terms: int, k: int, passes: int = 3, extra: int = 8, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(values, right vectors as rows) of the ``k`` largest singular values, by a randomised range of V'V and passes over the rows."""
    width = min(terms, k + extra)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(terms, width)))[0]
    sc: SparkContext = data.sparkSession.sparkContext
    for _ in range(passes):
        shared = sc.broadcast(basis)

        def gram(batch, shared=shared):
            for block in _blocks(batch, terms):
                yield [_transposed(*block[:3], _times(*block, shared.value), terms)]

        found = _summed(data, gram)
        product = found[0][: width * terms].reshape(width, terms).T  # V'V basis
        basis = np.linalg.qr(product)[0]
    # the singular values of V on the last basis
    shared = sc.broadcast(basis)

    def squares(batch):
        for block in _blocks(batch, terms):
            y = _times(*block, shared.value)
            yield [y.T @ y]

    gram_ = _summed(data, squares)[0][: width * width].reshape(width, width)
    value, turn = np.linalg.eigh((gram_ + gram_.T) / 2)
    order = np.argsort(value)[::-1][:k]
    return np.sqrt(np.maximum(value[order], 0.0)), (basis @ turn[:, order]).T


@dataclass
class Topics:
    """Topics as rows of term weights, the terms, and the squared error after every round."""

    weights: np.ndarray
    vocabulary: list[str]
    losses: list[float]

    def top(self, k: int = 10) -> list[tuple[int, str, list[str]]]:
        """(number, label, terms) of every topic, its ``k`` heaviest terms first."""
        out = []
        for number, row in enumerate(self.weights):
            best = np.lexsort((np.arange(len(row)), -np.round(row, 12)))[:k]
            names = [self.vocabulary[i] for i in best if row[i] > 0]
            out.append((number, " / ".join(names[:3]) or f"Topic {number}", names))
        return out


def fit(data: DataFrame, vocabulary: list[str], k: int, rounds: int = ROUNDS, least_fall: float = LEAST_FALL) -> Topics | None:
    """Topics of a matrix of :func:`matrix`; none for fewer than two rows or topics.  The error falls in every round."""
    n, terms = data.count(), len(vocabulary)
    k = min(k, n - 1, terms)
    if k < 2:
        return None
    sc = data.sparkSession.sparkContext
    value, vectors = singular(data, terms, k)
    start = np.empty((k, terms))
    for j in range(k):
        up, down = np.maximum(vectors[j], 0), np.maximum(-vectors[j], 0)
        half = up if np.linalg.norm(up) >= np.linalg.norm(down) else down
        start[j] = np.sqrt(value[j]) * half
    h = np.where(start > 0, start, max(start.mean(), TINY))
    losses: list[float] = []
    for _ in range(rounds):
        shared = sc.broadcast((h, h @ h.T))

        def sums(batch, shared=shared):
            topics, gram = shared.value
            for row, cell, worth, size in _blocks(batch, terms):
                target = _times(row, cell, worth, size, topics.T)
                w = _solve(target, gram, np.maximum(target, 0) / max(float(np.trace(gram)), TINY))
                error = float((worth * worth).sum() - 2 * (w * target).sum() + ((w @ gram) * w).sum())
                yield [w.T @ w, _transposed(row, cell, worth, w, terms), np.array([error])]

        ww, wv, error = _summed(data, sums)
        losses.append(float(error[0]))
        if len(losses) > 1 and losses[-2] - losses[-1] < least_fall * losses[0]:
            used = h
            break
        used, h = h, _solve(wv[: k * terms].reshape(k, terms).T, ww[: k * k].reshape(k, k), h.T).T
    return Topics(used, vocabulary, losses)


def weights(data: DataFrame, key: str, topics: Topics | None, least: float = 0.01) -> DataFrame:
    """(key, topic, weight): what each text has of each topic, where it is over ``least``; nothing without topics."""
    schema = f"{key} {data.schema[key].dataType.simpleString()}, topic int, weight double"
    if topics is None:
        return data.sparkSession.createDataFrame([], schema)
    shared = data.sparkSession.sparkContext.broadcast((topics.weights, topics.weights @ topics.weights.T))

    def run(batches):
        for batch in batches:
            h, gram = shared.value
            low = 0
            for row, cell, worth, size in _blocks(batch, h.shape[1]):
                target = _times(row, cell, worth, size, h.T)
                w = _solve(target, gram, np.maximum(target, 0) / max(float(np.trace(gram)), TINY), rounds=200)
                at, topic = np.nonzero(w > least)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + low)), pa.array(topic.astype(np.int32)), pa.array(np.round(w[at, topic], 4))], names=[key, "topic", "weight"])
                low += size

    return data.mapInArrow(run, schema)
