"""Language identification of code-switched text by a linear-chain CRF.

Every word gets a language.  Its features are hashed character n-grams with
boundary marks (those that touch a mark are its affixes) and the lexicon it
belongs to, if any; transitions between the labels of neighbouring words are
learned too.  Forward-backward gives each word its distribution over languages; a
document's prediction is the language with the largest share over its words.

The labelled texts are of one language each, so training sequences are made of
spans of different documents: that teaches emissions and what a switch costs.
Fitting runs on the driver over a bounded sample: ``per_language`` documents of a
language, of at most ``sample_chars`` code points each, chosen by hash.  Feature
weights are hashed to a fixed size, so the model's broadcast is bounded too.

Prediction takes whole texts.  All texts of a batch form one chain in which the
first word of a text forgets what came before.  The chain is folded into segments
that advance in step: transfer matrices of the segments, then their boundary
vectors, then all words, so the cost of a word is a few small products whatever
the length of its text, and memory is the batch's words times the languages.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a
null language is not learned from; a null id counts as not held out and is not
learned from either; without labelled rows all is ``und``; repeated rows and extra
columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, small_batches

UNDETERMINED = "und"
BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
PER_LANGUAGE, SAMPLE_CHARS, MOST_LANGUAGES = 400, 20_000, 200
LEXICON_WORDS = 500
SEQUENCES, SEQUENCE_WORDS, SPAN_WORDS = 3000, 80, (3, 40)
EPOCHS, BATCH_SEQUENCES, RATE, DECAY = 3, 100, 0.25, 1e-6


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (buckets, languages)
    lexicon: dict[str, int]  # word -> language
    lexicon_weights: np.ndarray  # (languages + 1, languages), the last row for words of no lexicon
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, languages) scores of distinct words."""
        n, k = len(words), len(self.languages)
        owner, bucket = features(words)
        out = np.empty((n, k))
        for label in range(k):
            out[:, label] = np.bincount(owner, self.weights[:, label][bucket], minlength=n)
        return out + self.lexicon_weights[self.lexicon_of(words)]

    def lexicon_of(self, words: list[str]) -> np.ndarray:
        get, none = self.lexicon.get, len(self.languages)
        return np.array([get(w, none) for w in words], np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index of the word, hash bucket) for every n-gram of every marked word."""
    marks = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.array([len(w) + 2 for w in words], np.int64))
    owners, buckets = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(marks) < n:
                continue
            key = np.full(len(marks) - n + 1, n, np.uint64)
            for j in range(n):
                key = (key ^ marks[j : j + len(key)]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            inside = owner[: len(key)] == owner[n - 1 :]
            owners.append(owner[: len(key)][inside])
            buckets.append((key[inside] >> np.uint64(8)).astype(np.int64) % BUCKETS)
    return np.concatenate(owners) if owners else np.zeros(0, np.int64), np.concatenate(buckets) if buckets else np.zeros(0, np.int64)


def forward_backward(emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised forward vectors, backward vectors and marginals of a chain of words.

    ``first`` marks words that begin a text; they take ``start`` in place of a
    transition, which also makes the backward vector before them uniform.
    """
    n, k = emissions.shape
    width = int(min(256, max(8, n**0.5)))
    rows = -(-n // width)
    local = np.zeros((rows * width, k))
    local[:n] = emissions - emissions.max(axis=1, keepdims=True)
    local = np.exp(local).reshape(rows, width, k)
    fresh = np.ones(rows * width, bool)
    fresh[:n] = first
    fresh = fresh.reshape(rows, width)
    a = np.exp(transitions - transitions.max())
    b = np.exp(start - start.max())
    unit = lambda x, axis: x / x.sum(axis=axis, keepdims=True)

    product = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for t in range(width):
        moved = (product.reshape(-1, k) @ a).reshape(rows, k, k)
        moved = np.where(fresh[:, t, None, None], product.sum(axis=2, keepdims=True) * b, moved) * local[:, t, None, :]
        product = moved / moved.max(axis=(1, 2), keepdims=True)
    before, after = np.empty((rows, k)), np.empty((rows, k))
    v = np.full(k, 1 / k)
    for r in range(rows):
        before[r] = v
        v = v @ product[r]
        v = v / v.sum()
    v = np.full(k, 1 / k)
    for r in range(rows - 1, -1, -1):
        after[r] = v
        v = product[r] @ v
        v = v / v.sum()
    alpha, beta = np.empty((rows, width, k)), np.empty((rows, width, k))
    v = before
    for t in range(width):
        v = unit(np.where(fresh[:, t, None], b, v @ a) * local[:, t], 1)
        alpha[:, t] = v
    v = after
    for t in range(width - 1, -1, -1):
        beta[:, t] = v
        v = unit(np.where(fresh[:, t, None], 1.0, (local[:, t] * v) @ a.T), 1)
    alpha, beta = alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]
    return alpha, beta, unit(alpha * beta, 1)


def _sequences(texts: dict[int, list[list[str]]], rng: np.random.Generator):
    """Code-switched sequences of (word, label), spans of random documents."""
    labels = sorted(texts)
    for _ in range(SEQUENCES):
        words, own = [], []
        while len(words) < SEQUENCE_WORDS:
            label = labels[rng.integers(len(labels))]
            source = texts[label][rng.integers(len(texts[label]))]
            size = int(rng.integers(*SPAN_WORDS)) if rng.random() < 0.7 else SEQUENCE_WORDS
            at = int(rng.integers(max(1, len(source) - size + 1)))
            span = source[at : at + size]
            words += span
            own += [label] * len(span)
        yield words[: 2 * SEQUENCE_WORDS], own[: 2 * SEQUENCE_WORDS]


def _lexicon(texts: dict[int, list[list[str]]], size: int) -> dict[str, int]:
    """The most frequent words that nearly always belong to one language."""
    counts = {label: Counter(w for words in own for w in words) for label, own in texts.items()}
    shares = {label: {w: n / c.total() for w, n in c.items() if n >= 3} for label, c in counts.items()}
    total = defaultdict(float)
    for own in shares.values():
        for w, p in own.items():
            total[w] += p
    out = {}
    for label, own in shares.items():
        clear = sorted((w for w, p in own.items() if p > 0.8 * total[w]), key=lambda w: (-own[w], w))
        out |= dict.fromkeys(clear[:size], label)
    return out


def split_words(texts: pa.Array) -> pa.ListArray:
    """The lower-cased words of each text, for training and for prediction."""
    return pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))


def split(text: str) -> list[str]:
    return [w for w in split_words(pa.array([text], pa.string()))[0].as_py() if any(map(str.isalpha, w))]


def train(samples: list[tuple[str, str]], seed: int = 1) -> Model | None:
    """A model from (language, text) pairs by stochastic gradient ascent of the CRF's likelihood."""
    languages = sorted({lang for lang, _ in samples})
    texts = defaultdict(list)
    for lang, text in samples:
        if words := split(text):
            texts[languages.index(lang)].append(words)
    if not texts:
        return None
    k = len(languages)
    model = Model(languages, np.zeros((BUCKETS, k)), _lexicon(texts, LEXICON_WORDS), np.zeros((k + 1, k)), np.zeros((k, k)), np.zeros(k))
    rng = np.random.default_rng(seed)
    sequences = list(_sequences(texts, rng))
    squares = [np.full_like(x, 1e-6) for x in (model.weights, model.lexicon_weights, model.transitions, model.start)]

    def climb(k_, value, gradient):
        squares[k_] += gradient**2
        value += RATE * gradient / np.sqrt(squares[k_])

    for _ in range(EPOCHS):
        order = rng.permutation(len(sequences))
        for low in range(0, len(order), BATCH_SEQUENCES):
            chosen = [sequences[i] for i in order[low : low + BATCH_SEQUENCES]]
            flat = [w for words, _ in chosen for w in words]
            label = np.array([x for _, own in chosen for x in own])
            first = np.zeros(len(flat), bool)
            first[np.cumsum([0, *(len(w) for w, _ in chosen[:-1])])] = True
            distinct, code = np.unique(np.array(flat, object), return_inverse=True)
            distinct = distinct.tolist()
            emission = model.emissions(distinct)[code]
            alpha, beta, share = forward_backward(emission, first, model.transitions, model.start)
            gap = -share
            gap[np.arange(len(flat)), label] += 1
            by_word = np.stack([np.bincount(code, gap[:, c], minlength=len(distinct)) for c in range(k)], axis=1)
            owner, bucket = features(distinct)
            grams = np.stack([np.bincount(bucket, by_word[:, c][owner], minlength=BUCKETS) for c in range(k)], axis=1)
            lexical = np.zeros_like(model.lexicon_weights)
            np.add.at(lexical, model.lexicon_of(distinct), by_word)
            inner = np.flatnonzero(~first)
            local = np.exp(emission[inner] - emission[inner].max(axis=1, keepdims=True)) * beta[inner]
            pair = alpha[inner - 1][:, :, None] * np.exp(model.transitions - model.transitions.max()) * local[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            moves = -pair.sum(axis=0)
            np.add.at(moves, (label[inner - 1], label[inner]), 1)
            begin = gap[first].sum(axis=0)
            climb(0, model.weights, grams - DECAY * len(flat) * model.weights)
            climb(1, model.lexicon_weights, lexical)
            climb(2, model.transitions, moves)
            climb(3, model.start, begin)
    model.weights = model.weights.astype(np.float32)
    return model


def label_batch(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all words of a batch: text number, place in the text, marginals; words without a letter are left out."""
    parts = split_words(texts)
    words = pc.dictionary_encode(parts.flatten())
    distinct = words.dictionary.to_pylist()
    lettered = np.array([any(map(str.isalpha, w)) for w in distinct], bool)
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    code = words.indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    place = np.arange(len(owner)) - (np.searchsorted(owner, owner) if len(owner) else 0)
    good = lettered[code] if len(code) else np.zeros(0, bool)
    owner, code, place = owner[good], code[good], place[good]
    if not len(code):
        return owner, place, np.zeros((0, len(model.languages)))
    keep = np.flatnonzero(lettered)
    emission = np.zeros((len(distinct), len(model.languages)))
    emission[keep] = model.emissions([distinct[i] for i in keep])
    first = np.r_[True, owner[1:] != owner[:-1]]
    return owner, place, forward_backward(emission[code], first, model.transitions, model.start)[2]


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def fit(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """A model from a bounded sample of the rows where ``training`` holds.

    A language's sample are its ``per_language`` texts of the least hash, long ones
    cut to ``sample_chars``, so that a language with long texts alone is learned too.  What
    reaches the driver is bounded by that and by ``most_languages``, the most
    frequent ones: the others, of a column with stray values, are not learned.
    """
    able = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in able.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not sizes:
        return None
    # hashes up to this mark hold about twice the texts that are wanted, so few rows are ranked
    mark = F.lit(None).cast("long")
    for lang, n in sizes.items():
        mark = F.when(F.col(lang_col) == lang, F.lit(min(2**63 - 1, -(2**63) + int(2.0**64 * (2 * per_language + 64) / n)))).otherwise(mark)
    spot = F.xxhash64(F.col(text_col))
    near = able.where(spot <= mark).select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, sample_chars).alias("text"), spot.alias("spot"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("spot", "text"))
    rows = near.distinct().withColumn("place", place).where(F.col("place") <= per_language).collect()
    return train([(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["place"]))])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """doc_id, kept (the value of ``keep``), lang_pred, score, n_words, spans.

    ``spans`` are runs of words (places among all words of the text) of one language.
    """
    small_batches(docs.sparkSession)
    languages = model.languages if model else []
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), (keep if keep is not None else F.lit(False)).alias("kept"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            n, lang, score, count, spans = batch.num_rows, [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            if shared.value is not None:
                owner, place, share = label_batch(shared.value, batch.column(2))
                count = np.bincount(owner, minlength=n)
                mass = np.stack([np.bincount(owner, share[:, c], minlength=n) for c in range(len(languages))], axis=1)
                best = mass.argmax(axis=1)
                score = np.where(count > 0, np.minimum(1.0, mass[np.arange(n), best] / np.maximum(count, 1)), 0.0)
                lang = [languages[b] if c else UNDETERMINED for b, c in zip(best.tolist(), count.tolist(), strict=True)]
                if len(owner):
                    label = share.argmax(axis=1)
                    edge = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (label[1:] != label[:-1])])
                    last = np.r_[edge[1:], len(owner)] - 1
                    for o, a, b, x in zip(owner[edge].tolist(), place[edge].tolist(), place[last].tolist(), label[edge].tolist(), strict=True):
                        spans[o].append({"start": a, "stop": b + 1, "lang": languages[x]})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(count, pa.int64()), pa.array(spans, _SPANS)],
                names=["doc_id", "kept", "lang_pred", "score", "n_words", "spans"],
            )

    kind, flag = rows.schema["doc_id"].dataType.simpleString(), rows.schema["kept"].dataType.simpleString()
    return rows.mapInArrow(bounded(run), f"doc_id {kind}, kept {flag}, lang_pred string, score double, n_words long, spans array<struct<start:int,stop:int,lang:string>>")
