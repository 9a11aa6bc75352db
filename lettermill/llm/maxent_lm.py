"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

Tokens are ASCII-lower-cased words and one end mark a text.  The steps:

1. Blocks.  Each task packs its texts into blocks: local word codes, the hashes
   of the block's distinct words, and their counts over its training texts.  A
   block is named by its content, so runs over one table train alike.
2. Counts.  The blocks' vocabularies, not their tokens, go to hash buckets, where
   corpus counts are summed; every block gets its own words' counts back.  This
   exchange grows with the corpus's vocabulary.  A bucket holds about
   ``BUCKET_WORDS`` entries; as a frequent word has one in every block, corpora of
   more than ``most_blocks`` blocks sum them in salted parts first.
3. Targets.  Every word has a class and a place in it.  The ``HEAD`` most frequent
   words have classes of ``CLASS_WORDS``; every other word has the class of its
   count's magnitude and one of ``CLASS_WORDS`` groups by its hash, inside which its
   probability is (count + 1) / group total.  A word that training never saw is the
   only member of the class of count 0.  For training, a tail word's own occurrence
   is left out of its count, so the model learns how often new and rare words come
   up.
4. Training.  log P(class) and log P(place | class) are sums of weights of hashed
   features of whole words, frequent or not: the word before, the two words before,
   and a skip over one word; the rows are hashed, so tables do not grow with
   the vocabulary.  Tasks run stochastic gradient updates over their blocks; after
   each round the token-weighted mean of their weights is broadcast again.  The
   rounds split the blocks, so together they see every training token once.
5. Scoring in numpy batches over the same blocks, every token of every text.

Broadcasts (weights, head words) have sizes fixed by parameters: ``HEAD`` bounds the
words with a place of their own, ``WORD_BITS`` and ``PAIR_BITS`` the feature rows.
Words are told apart by 64-bit hashes, as features by 16 bits of them.  Nothing is
sampled; blocks and counts are staged in the shared folder, so a lost executor costs
its own tasks only.

Defined cases: a null text is an empty one, a single end mark; a null id counts as
not held out; repeated rows are scored each and counted each; extra columns do not
matter; an empty table gives an empty result; with no training text the base is
that of N = 0 and V = 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, small_batches, stage

HEAD, CLASS_WORDS, TAIL_CLASSES = 640, 32, 12
HEAD_CLASSES = HEAD // CLASS_WORDS
CLASSES = HEAD_CLASSES + TAIL_CLASSES
GROUPS = TAIL_CLASSES * CLASS_WORDS
BLOCK_TOKENS, BUCKET_WORDS, TASK_TOKENS, MOST_BLOCKS = 1 << 19, 1_000_000, 8_000_000, 65_536
WORD_BITS, PAIR_BITS = 13, 14
#: Rows of the class tables (word before, pair before, skip), and which of them the tables of places take too.
CLASS_BITS, PLACE_FEATURES = (WORD_BITS, PAIR_BITS, WORD_BITS), (0, 2)
ROUNDS, BATCH_TOKENS, RATE, FIRST_SQUARES, PARTS = 2, 4096, 0.8, 16.0, 16
END_HASH, BEGIN = np.uint64(0), np.uint16(0x9E37)


def tail_class(counts: np.ndarray) -> np.ndarray:
    """0 for count 0, else 1 + floor(log2(count)) up to 8, then one class for every factor of 8, the last class open."""
    two = (np.frexp(counts.astype(np.float64))[1] * (counts > 0)).astype(np.int64)
    return np.minimum(np.where(two <= 8, two, 8 + (two - 6) // 3), TAIL_CLASSES - 1)


def group_of(hashes: np.ndarray) -> np.ndarray:
    """The place that a tail word's hash gives it in a class."""
    return ((hashes >> np.uint64(40)) % np.uint64(CLASS_WORDS)).astype(np.int64)


# blocks

_BLOCK = "block string, doc_id array<long>, held array<boolean>, n_tokens array<int>, codes binary, hashes binary, counts binary, n_words long"


def _block(ids: list, held: list[bool], texts: list[str]) -> dict:
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    flat = parts.flatten()
    lengths = np.diff(parts.offsets.to_numpy())
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), lengths)[full]
    words = pc.dictionary_encode(flat.filter(pa.array(full)))
    sizes = np.bincount(owner, minlength=len(texts)) + 1
    hashes = np.array([END_HASH, *(max(1, xxhash.xxh64_intdigest(w)) for w in words.dictionary.to_pylist())], np.uint64)
    codes = np.zeros(int(sizes.sum()), np.int32)  # 0 is the end mark, last of every text
    inner = np.ones(len(codes), bool)
    inner[np.cumsum(sizes) - 1] = False
    codes[inner] = words.indices.to_numpy() + 1 if len(words) else 0
    learned = np.repeat(~np.array(held, bool), sizes)
    counts = np.bincount(codes[learned], minlength=len(hashes)).astype(np.int64)
    codes = codes.astype(np.uint16 if len(hashes) <= 1 << 16 else np.uint32).tobytes()
    name = xxhash.xxh3_128(codes)
    for part in (hashes, counts, sizes):
        name.update(part.tobytes())
    return {
        "block": name.hexdigest(), "doc_id": ids, "held": held, "n_tokens": sizes.astype(np.int32), "codes": zstandard.compress(codes, 3), "hashes": hashes.tobytes(),
        "counts": counts.tobytes(), "n_words": len(hashes),
    }


def codes_of(row: dict) -> np.ndarray:
    """The word codes of a block, which travel compressed."""
    raw = zstandard.decompress(row["codes"])
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * sum(row["n_tokens"]) else np.uint32)


_BLOCK_ARROW = pa.schema([
    ("block", pa.string()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int32())),
    ("codes", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary()), ("n_words", pa.int64()),
])


def blocks(docs: DataFrame, held: Column, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        ids, flags, texts, size = [], [], [], 0
        for batch in batches:
            for i, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(i)
                flags.append(h)
                texts.append(t)
                size += len(t)
                if size >= 5 * BLOCK_TOKENS:
                    yield pa.RecordBatch.from_pylist([_block(ids, flags, texts)], schema=_BLOCK_ARROW)
                    ids, flags, texts, size = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_block(ids, flags, texts)], schema=_BLOCK_ARROW)

    return rows.mapInArrow(bounded(run), _BLOCK)


# counts


def _to_buckets(buckets: int, salts: int):
    def run(batches):
        for batch in batches:
            for block, hashes, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h, c = np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.int64)
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                present = np.flatnonzero(np.diff(edges))
                cut = [order[edges[b] : edges[b + 1]] for b in present.tolist()]
                salt = int(block[:8], 16) % salts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(present, pa.int32()), pa.array([salt] * len(cut), pa.int32()), pa.array([block] * len(cut), pa.string()),
                        pa.array([h[x].tobytes() for x in cut], pa.binary()), pa.array([c[x].tobytes() for x in cut], pa.binary()),
                    ],
                    names=["bucket", "salt", "block", "hashes", "counts"],
                )

    return run


_SENT = "bucket int, salt int, block string, hashes binary, counts binary"
_TOTAL = "bucket int, salt int, hashes binary, counts binary"
_FACTS = ", types long, tokens long, mass array<long>, left_out array<long>, top array<struct<hash:long,n:long>>"
_ANSWER = "bucket int, block string, counts binary"
_TOP = pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64())]))


def _summed(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, total counts) of a group of entries, hashes sorted."""
    hashes = np.frombuffer(b"".join(group.column("hashes").to_pylist()), np.uint64)
    counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.int64)
    words, code = np.unique(hashes, return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, code, counts)
    return words, total


def _total(group: pa.Table, facts: bool) -> pa.Table:
    """One row: the totals of a group's words and, of a whole bucket, what the model must know of them."""
    words, total = _summed(group)
    one = lambda x, kind: pa.array([x], kind)
    columns = {
        "bucket": one(group.column("bucket")[0].as_py(), pa.int32()), "salt": one(0, pa.int32()),
        "hashes": one(words.tobytes(), pa.binary()), "counts": one(total.tobytes(), pa.binary()),
    }
    if facts:
        seen = total > 0
        words, total = words[seen], total[seen]
        place = group_of(words)
        add = lambda kind, n: np.bincount(kind * CLASS_WORDS + place, n, minlength=GROUPS).astype(np.int64).tolist()
        top = np.lexsort((words, -total))[:HEAD]
        columns |= {
            "types": one(len(words), pa.int64()), "tokens": one(int(total.sum()), pa.int64()), "mass": one(add(tail_class(total), total + 1), pa.list_(pa.int64())),
            "left_out": one(add(tail_class(total - 1), total), pa.list_(pa.int64())), "top": one([{"hash": int(words[i].astype(np.int64)), "n": int(total[i])} for i in top], _TOP),
        }
    return pa.table(columns)


def _answer(entries: pa.Table, totals: pa.Table) -> pa.Table:
    """Every entry with the totals of its words in place of its own counts."""
    words, total = _summed(totals)
    raw = entries.column("hashes").to_pylist()
    counts = [total[np.searchsorted(words, np.frombuffer(x, np.uint64))].tobytes() for x in raw]
    return pa.table({"bucket": entries.column("bucket"), "block": entries.column("block"), "counts": pa.array(counts, pa.binary())})


def counted(made: DataFrame, buckets: int, salts: int) -> tuple[DataFrame, DataFrame]:
    """The totals, one row a bucket, and the answers to the blocks."""
    parts = sent = made.select("block", "hashes", "counts").mapInArrow(bounded(_to_buckets(buckets, salts)), _SENT)
    if salts > 1:
        parts = stage(sent.groupBy("bucket", "salt").applyInArrow(lambda group: _total(group, False), _TOTAL), "lm-parts")
    totals = stage(parts.groupBy("bucket").applyInArrow(lambda group: _total(group, True), _TOTAL + _FACTS), "lm-totals")
    given = totals.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "hashes", "counts")
    answers = sent.groupBy("bucket", "salt").cogroup(given.groupBy("bucket", "salt")).applyInArrow(_answer, _ANSWER)
    return totals, answers


@dataclass
class Counts:
    """What the corpus counts say, of a size that parameters fix."""

    tokens: int
    types: int
    head: np.ndarray  # hashes of head words, most frequent first
    head_counts: np.ndarray
    mass: np.ndarray  # sum of count + 1 over the words of each group of each tail class
    left_out: np.ndarray  # training tokens of each such group, their own occurrence left out


def gather(totals: DataFrame) -> Counts:
    r = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    top = totals.select(F.explode("top").alias("t")).select("t.hash", "t.n").orderBy(F.desc("n"), "hash").limit(HEAD).collect()
    head, n = np.array([x["hash"] for x in top], np.int64).astype(np.uint64), np.array([x["n"] for x in top], np.int64)
    mass, out = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
    for x in totals.select(F.posexplode(F.arrays_zip("mass", "left_out")).alias("at", "x")).groupBy("at").agg(F.sum("x.mass").alias("mass"), F.sum("x.left_out").alias("left_out")).collect():
        mass[x["at"]], out[x["at"]] = x["mass"], x["left_out"]
    place = group_of(head)
    mass -= np.bincount(tail_class(n) * CLASS_WORDS + place, n + 1, minlength=GROUPS).astype(np.int64)
    out -= np.bincount(tail_class(np.maximum(n - 1, 0)) * CLASS_WORDS + place, n, minlength=GROUPS).astype(np.int64)
    mass[:CLASS_WORDS] = 1  # the one unknown word
    return Counts(r["tokens"], r["types"], head, n, mass, out)


# targets

_ENCODED = "doc_id array<long>, held array<boolean>, n_tokens array<int>, n_known array<int>, base array<double>, tail array<double>, codes binary, words binary, classes binary, places binary, lower binary, block string, part int"


def _encode(counts: Counts):
    order = np.argsort(counts.head)
    head = counts.head[order]
    logs = lambda x: np.log10(np.maximum(x, 1).astype(np.float64))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                hashes, codes = np.frombuffer(row["hashes"], np.uint64), codes_of(row)
                n, buckets = np.zeros(len(hashes), np.int64), (hashes % np.uint64(row["buckets"])).astype(np.int64)
                for answer in row["answers"]:
                    n[buckets == answer["bucket"]] = np.frombuffer(answer["counts"], np.int64)
                base = logs(n + 1) - math.log10(max(1, counts.tokens + counts.types + 1))
                kind, place = tail_class(n), group_of(hashes)
                klass, tail = HEAD_CLASSES + kind, np.where(n > 0, logs(n + 1) - logs(counts.mass)[kind * CLASS_WORDS + place], 0.0)
                if len(head):
                    at = np.minimum(np.searchsorted(head, hashes), len(head) - 1)
                    hit = head[at] == hashes
                    klass, place, tail = np.where(hit, order[at] // CLASS_WORDS, klass), np.where(hit, order[at] % CLASS_WORDS, place), np.where(hit, 0.0, tail)
                # own occurrence left out: the count's class changes where the count is the least of its class
                lower = (klass >= HEAD_CLASSES) & (n > 0) & (tail_class(np.maximum(n - 1, 0)) < kind)
                sizes = np.array(row["n_tokens"], np.int64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                total = lambda x: np.bincount(owner, x[codes], minlength=len(sizes))
                words = ((hashes * _ODD) >> np.uint64(48)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["doc_id"]], pa.list_(pa.int64())), pa.array([row["held"]], pa.list_(pa.bool_())), pa.array([row["n_tokens"]], pa.list_(pa.int32())),
                        pa.array([total((n > 0).astype(float)).astype(np.int32)], pa.list_(pa.int32())), pa.array([total(base)], pa.list_(pa.float64())), pa.array([total(tail)], pa.list_(pa.float64())),
                        pa.array([row["codes"]], pa.binary()), *(pa.array([x.tobytes()], pa.binary()) for x in (words, klass.astype(np.uint8), place.astype(np.uint8), lower.astype(np.uint8))),
                        pa.array([row["block"]], pa.string()), pa.array([int(row["block"][8:16], 16) % ROUNDS], pa.int32()),
                    ],
                    names=[c.split()[0] for c in _ENCODED.split(", ")],
                )

    return run


_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(row: dict, learning: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word as a feature, class, place in the class) of every token of a block; in learning, own occurrences are left out."""
    codes = codes_of(row)
    words, classes, places = np.frombuffer(row["words"], np.uint16), np.frombuffer(row["classes"], np.uint8), np.frombuffer(row["places"], np.uint8)
    if learning:
        classes = classes - np.frombuffer(row["lower"], np.uint8)
    return words[codes], classes[codes].astype(np.int64), places[codes].astype(np.int64)


# the model


@dataclass
class Model:
    """Weights of log P(class) and log P(place | class), natural logarithms up to a constant."""

    class_bias: np.ndarray
    word_bias: np.ndarray
    tables: list[np.ndarray] = field(default_factory=list)  # of classes: word before, pair before, skip of 1
    word_tables: list[np.ndarray] = field(default_factory=list)  # of places in a class: word before, skip of 1

    @staticmethod
    def start(counts: Counts) -> Model:
        by_class = np.zeros((CLASSES, CLASS_WORDS))
        by_class[:HEAD_CLASSES].reshape(-1)[: len(counts.head_counts)] = counts.head_counts
        by_class[HEAD_CLASSES:] = np.maximum(counts.left_out, 0).reshape(TAIL_CLASSES, CLASS_WORDS)
        classes = by_class.sum(axis=1) + 0.5
        # a group without a word of its class cannot come up, one with a word can
        able = np.concatenate([by_class[:HEAD_CLASSES] > 0, ((counts.mass > 0) | (counts.left_out > 0)).reshape(TAIL_CLASSES, CLASS_WORDS)])
        word_bias = np.where(able, np.log(by_class + 0.5), -30.0)
        word_bias -= word_bias.max(axis=1, keepdims=True)
        zeros = lambda bits, c: np.zeros((1 << bits, c), np.float32)
        return Model(np.log(classes / classes.sum()).astype(np.float32), word_bias.astype(np.float32), [zeros(bits, CLASSES) for bits in CLASS_BITS], [zeros(PAIR_BITS, CLASS_WORDS) for _ in PLACE_FEATURES])

    def flat(self) -> np.ndarray:
        return np.concatenate([t.ravel() for t in (*self.tables, *self.word_tables)])

    def filled(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for t in (*self.tables, *self.word_tables):
            out.append(flat[at : at + t.size].reshape(t.shape).astype(np.float32))
            at += t.size
        return Model(self.class_bias, self.word_bias, out[: len(self.tables)], out[len(self.tables) :])

    @staticmethod
    def contexts(words: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        """The rows of the class tables for each token: hashes of whole words."""
        back = []
        for k in (1, 2):
            b = np.full(len(words), BEGIN, np.uint16)
            b[k:] = np.where(place[k:] >= k, words[:-k] if len(words) > k else words[:0], BEGIN)
            back.append(b)
        with np.errstate(over="ignore"):
            pair = (back[1].astype(np.uint32) * np.uint32(65_537) ^ back[0]) * np.uint32(2654435761)
        return [back[0] >> np.uint16(16 - WORD_BITS), (pair >> np.uint32(32 - PAIR_BITS)).astype(np.uint16), back[1] >> np.uint16(16 - WORD_BITS)]

    def class_scores(self, rows: list[np.ndarray]) -> np.ndarray:
        score = self.tables[0][rows[0]] + self.class_bias
        for table, row in zip(self.tables[1:], rows[1:], strict=True):
            score += table[row]
        return score

    @staticmethod
    def word_rows(rows: list[np.ndarray], own: np.ndarray, klass: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            return [((rows[f][own].astype(np.uint32) * np.uint32(CLASSES) + klass.astype(np.uint32)) * np.uint32(2654435761) >> np.uint32(32 - PAIR_BITS)).astype(np.uint16) for f in PLACE_FEATURES]

    def place_scores(self, rows: list[np.ndarray], klass: np.ndarray) -> np.ndarray:
        score = self.word_bias[klass]
        for table, row in zip(self.word_tables, rows, strict=True):
            score += table[row]
        return score

    def log10(self, words: np.ndarray, klass: np.ndarray, inner: np.ndarray, place: np.ndarray, batch: int = 1 << 12) -> np.ndarray:
        """log10 of P(class) P(place | class) of each token; the class of unknown words has one place."""
        contexts = self.contexts(words, place)
        out = np.empty(len(words))
        for low in range(0, len(words), batch):
            part = klass[low : low + batch]
            rows = [c[low : low + batch] for c in contexts]
            log = _chosen(self.class_scores(rows), part)
            own = np.flatnonzero(part != HEAD_CLASSES)
            log[own] += _chosen(self.place_scores(self.word_rows(rows, own, part[own]), part[own]), inner[low + own])
            out[low : low + batch] = log
        return out / math.log(10)


def _chosen(score: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each row of scores, in one place of the row."""
    score -= score.max(axis=1, keepdims=True)
    own = score[np.arange(len(at)), at].astype(np.float64)
    return own - np.log(np.exp(score, out=score).sum(axis=1))


def _gap(score: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Gradient of that logarithm by the scores."""
    score -= score.max(axis=1, keepdims=True)
    np.exp(score, out=score)
    score *= -1 / score.sum(axis=1, keepdims=True)
    score[np.arange(len(at)), at] += 1
    return score


def _climb(table: np.ndarray, squares: np.ndarray, row: np.ndarray, gradient: np.ndarray) -> None:
    """An AdaGrad update, of one rate a row, of the rows that a batch touches."""
    order = np.argsort(row, kind="stable")
    ordered = row[order]
    edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    total, rows = np.add.reduceat(gradient.take(order, 0), edge, axis=0), ordered[edge]
    squares[rows] += np.einsum("ij,ij->i", total, total)
    total *= (RATE / np.sqrt(squares[rows]))[:, None]
    table[rows] += total


def learn(model: Model, squares: list[np.ndarray], words: np.ndarray, klass: np.ndarray, inner: np.ndarray, place: np.ndarray) -> None:
    """Gradient updates over the tokens of a block, in place."""
    contexts = Model.contexts(words, place)
    for low in range(0, len(words), BATCH_TOKENS):
        part = klass[low : low + BATCH_TOKENS]
        rows = [c[low : low + BATCH_TOKENS] for c in contexts]
        gap = _gap(model.class_scores(rows), part)
        for table, square, row in zip(model.tables, squares, rows, strict=False):
            _climb(table, square, row, gap)
        own = np.flatnonzero(part != HEAD_CLASSES)
        if len(own):
            word_rows = Model.word_rows(rows, own, part[own])
            gap = _gap(model.place_scores(word_rows, part[own]), inner[low + own])
            for table, square, row in zip(model.word_tables, squares[len(model.tables) :], word_rows, strict=True):
                _climb(table, square, row, gap)


def _places(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def train(encoded: DataFrame, start: Model, tokens: int) -> Model:
    spark = encoded.sparkSession
    model = start
    tasks = max(1, math.ceil(tokens / ROUNDS / TASK_TOKENS))
    for round_ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            own = shared.value.filled(shared.value.flat().copy())
            squares = [np.full(len(t), FIRST_SQUARES, np.float32) for t in (*own.tables, *own.word_tables)]
            seen = 0
            for batch in batches:
                for row in batch.to_pylist():
                    sizes, held = np.array(row["n_tokens"], np.int64), np.array(row["held"], bool)
                    place, learned = _places(sizes), np.repeat(~held, sizes)
                    learn(own, squares, *(x[learned] for x in (*tokens_of(row, True), place)))
                    seen += int(learned.sum())
            if seen:
                task = TaskContext.get().partitionId()
                parts = np.array_split(own.flat(), PARTS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(PARTS), pa.int32()), pa.array([task] * PARTS, pa.int32()), pa.array([seen] * PARTS, pa.int64()), pa.array([p.astype(np.float16).tobytes() for p in parts], pa.binary())],
                    names=["part", "task", "seen", "weights"],
                )

        def mean(batches):
            # the tasks come in order, so the sums are the same in every run
            total, weight = {}, {}
            for batch in batches:
                for part, _, seen, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    x = np.frombuffer(raw, np.float16).astype(np.float64) * seen
                    total[part] = total[part] + x if part in total else x
                    weight[part] = weight.get(part, 0) + seen
            for part, x in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([(x / weight[part]).astype(np.float32).tobytes()], pa.binary())], names=["part", "weights"])

        rows = encoded.where(F.col("part") == round_).select("n_tokens", "held", "codes", "words", "classes", "places", "lower", "block")
        # which blocks a task learns from, and in what order, depends on their content only
        rows = rows.repartition(tasks, "block").sortWithinPartitions("block")
        local = rows.mapInArrow(bounded(run), "part int, task int, seen long, weights binary").repartition(PARTS, "part").sortWithinPartitions("part", "task")
        got = {r["part"]: r["weights"] for r in local.mapInArrow(mean, "part int, weights binary").collect()}
        if got:
            model = model.filled(np.frombuffer(b"".join(got[p] for p in sorted(got)), np.float32))
        shared.unpersist()
    return model


def score(encoded: DataFrame, model: Model, counts: Counts) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    counts_tokens = counts.tokens

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["n_tokens"], np.int64)
                logs = shared.value.log10(*tokens_of(row, False), _places(sizes))
                total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), logs, minlength=len(sizes)) + np.array(row["tail"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_id"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(sizes, pa.int64()), pa.array(row["n_known"], pa.int64()),
                        pa.array([counts_tokens] * len(sizes), pa.int64()), pa.array(row["base"], pa.float64()), pa.array(total, pa.float64()),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return encoded.drop("lower", "block", "part").mapInArrow(bounded(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    small_batches(docs.sparkSession)
    made = stage(blocks(docs, held, id_col, text_col), "lm-blocks")
    amount = made.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("entries"), F.count(F.lit(1)).alias("blocks")).first()
    buckets, salts = max(1, math.ceil(amount["entries"] / BUCKET_WORDS)), max(1, math.ceil(amount["blocks"] / most_blocks))
    totals, answers = counted(made, buckets, salts)
    counts, answers = gather(totals), stage(answers, "lm-answers")
    back = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    joined = made.drop("counts", "n_words").join(back, "block").withColumn("buckets", F.lit(buckets))
    encoded = stage(joined.mapInArrow(bounded(_encode(counts)), _ENCODED), "lm-encoded")
    model = train(encoded, Model.start(counts), counts.tokens)
    return score(encoded, model, counts)
