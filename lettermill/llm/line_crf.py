"""Quality of documents from a linear-chain CRF over their lines.

Every line that is not blank is a node labelled good or bad.  A line is described
by counts over its characters and words (letters, case, digits, symbols, repeated
words, what words and the line end in, whether it repeats a line just before), each
cut into a few steps; a node sees the steps of its own line and of the lines before
and after.  Forward-backward gives each line its probability of being good, and the
mean over the lines, weighted by their lengths, gives the document's score after a
logistic calibration.

Only documents are labelled, and bad ones hold good lines.  So training starts from
lines that all have their document's label and are seen without their neighbours, and
then asks the model itself: lines of a bad document that it holds for good become good,
as long as a part of the document stays bad.  Fitting runs on the driver over a bounded sample of ``per_class`` documents
a class, of their first ``sample_chars`` code points each; weights have a fixed size.

Scoring takes whole texts in UTF-8 blocks of about ``BLOCK`` bytes that end where a
line ends.  Lines over ``UNIT`` bytes are several nodes.  A text of several blocks is
swept twice, forwards for the messages at the seams and backwards for the marginals,
so memory is a block and the text, and results do not depend on where blocks end.

Defined cases: a null text counts as empty; a text without a non-blank line is one
blank node of weight 1; without labelled rows every score is 0.5; rows labelled both ways are learned from
both ways, rows that share an id by the least of their texts; null ids count as not held out and have no label; repeated rows are
scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, fresh, small, small_batches, stage
from .langid import fold, forward_backward

PER_CLASS, SAMPLE_CHARS = 1000, 20_000
THRESHOLD = 0.3
UNIT, BLOCK = 4096, 1 << 20
STEPS = 8  # values of a feature; one more stands for a line beyond the text's edge
MEMORY = 8  # lines looked back at for repeats
ROUNDS, CLIMBS, RATE, DECAY = 3, 60, 0.2, 1e-4
#: Share of a bad document's characters that stay bad at least when its lines are relabelled.
LEAST_BAD = 0.25
#: Classes of code points.
SPACE, LOWER, UPPER, LETTER, DIGIT, PUNCTUATION, SYMBOL, OTHER = range(8)
FEATURES = ("length", "words", "letters", "upper", "digits", "punctuation", "symbols", "other", "word_length", "distinct", "stutter", "commonest", "odd_ends", "runs", "first", "last", "repeats")


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point of the basic plane, by its general category."""
    by_category = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Lm": LETTER, "Lo": LETTER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT}
    kinds = {"P": PUNCTUATION, "S": SYMBOL, "Z": SPACE, "M": LETTER}
    out = np.full(1 << 16, OTHER, np.uint8)
    for c in range(1 << 16):
        category = unicodedata.category(chr(c))
        out[c] = by_category.get(category, kinds.get(category[0], OTHER))
    out[9:14] = SPACE
    return out


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 for none, STEPS - 1 for all, even steps between."""
    share = part / np.maximum(whole, 1)
    return np.where(share <= 0, 0, np.where(share >= 1, STEPS - 1, 1 + np.minimum(STEPS - 3, share * (STEPS - 2)))).astype(np.uint8)


def _log(x: np.ndarray, base: float) -> np.ndarray:
    return np.minimum(STEPS - 1, np.log(np.maximum(x, 1)) / np.log(base)).astype(np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


@dataclass
class Lines:
    """The nodes of a stretch of text: text number, length in code points, hash, steps of the features."""

    owner: np.ndarray
    size: np.ndarray
    key: np.ndarray
    steps: np.ndarray  # (lines, features), the last one filled in by :func:`chain`

    def take(self, rows) -> Lines:
        return Lines(self.owner[rows], self.size[rows], self.key[rows], self.steps[rows])


def join(parts: list[Lines]) -> Lines:
    return Lines(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("owner", "size", "key", "steps")))


def _cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Byte offsets where nodes begin: texts, lines, and pieces of lines longer than UNIT."""
    at = np.unique(np.concatenate([begins, np.flatnonzero(data == 10) + 1]))
    at = at[at < len(data)]
    sizes = np.diff(np.r_[at, len(data)])
    pieces = []
    for k in np.flatnonzero(sizes > UNIT).tolist():
        spot, end = int(at[k]) + UNIT, int(at[k] + sizes[k])
        while spot < end:
            while (data[spot] & 0xC0) == 0x80:
                spot -= 1
            pieces.append(spot)
            spot += UNIT
    return np.unique(np.concatenate([at, np.array(pieces, np.int64)])) if pieces else at


def describe(data: np.ndarray, begins: np.ndarray, blanks: bool = True) -> Lines:
    """The nodes of UTF-8 bytes in which texts begin at ``begins`` (ascending, the first is 0; equal ones are empty texts).

    With ``blanks``, a text without any has a blank one.
    """
    begins = np.asarray(begins, np.int64)
    cuts = _cuts(data, begins) if len(data) else np.zeros(0, np.int64)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = np.where(code < 1 << 16, _classes()[np.minimum(code, (1 << 16) - 1)], SYMBOL).astype(np.uint8)
    point = np.cumsum((data & 0xC0) != 0x80)
    low = np.r_[0, point[cuts[1:] - 1]] if len(cuts) else cuts
    n = len(cuts)
    line = np.repeat(np.arange(n), np.diff(np.r_[low, len(code)]))
    counts = np.bincount(line * 8 + kind, minlength=n * 8).reshape(n, 8) if n else np.zeros((0, 8), np.int64)
    solid = counts.sum(axis=1) - counts[:, SPACE]
    letters = counts[:, LOWER] + counts[:, UPPER] + counts[:, LETTER]

    # words: runs without white space, inside a node
    filled = kind != SPACE
    fresh_ = np.r_[True, line[1:] != line[:-1]] if len(code) else np.zeros(0, bool)
    start = filled & (fresh_ | ~np.r_[False, filled[:-1]]) if len(code) else filled
    first = np.flatnonzero(start)
    word = np.cumsum(start) - 1
    place = np.arange(len(code)) - (first[np.maximum(word, 0)] if len(first) else 0)
    with np.errstate(over="ignore"):
        letter_key = np.where(filled, _mix((code.astype(np.uint64) << np.uint64(20)) + (place & 0xFFFFF).astype(np.uint64) + np.uint64(1)), np.uint64(0))
        word_key = np.add.reduceat(letter_key, first) if len(first) else np.zeros(0, np.uint64)
    owner_line = line[first]
    words = np.bincount(owner_line, minlength=n)
    stop = np.flatnonzero(filled & np.r_[start[1:] | ~filled[1:], True]) if len(code) else first
    ends, marked = kind[stop], kind[np.maximum(stop - 1, 0)] == PUNCTUATION
    odd_end = (ends == SYMBOL) | (ends == OTHER) | ((ends == PUNCTUATION) & ((marked & (stop > first)) | np.isin(code[stop], _ODD)))
    odd = np.bincount(owner_line, odd_end, minlength=n)
    stutter = np.bincount(owner_line[1:], (word_key[1:] == word_key[:-1]) & (owner_line[1:] == owner_line[:-1]), minlength=n) if len(first) > 1 else np.zeros(n)
    order = np.lexsort((word_key, owner_line))
    sorted_line, sorted_key = owner_line[order], word_key[order]
    group = np.flatnonzero(np.r_[True, (sorted_line[1:] != sorted_line[:-1]) | (sorted_key[1:] != sorted_key[:-1])]) if len(order) else order
    times = np.diff(np.r_[group, len(order)])
    distinct = np.bincount(sorted_line[group], minlength=n)
    commonest = np.zeros(n, np.int64)
    np.maximum.at(commonest, sorted_line[group], times)
    marks = (kind == PUNCTUATION) | (kind == SYMBOL)
    twice = marks & np.r_[False, (code[1:] == code[:-1]) & (line[1:] == line[:-1])] if len(code) else marks
    runs = np.bincount(line, twice, minlength=n)
    keys = np.zeros(n, np.uint64)
    if len(first):
        own = np.flatnonzero(words)
        begin = np.searchsorted(owner_line, own)
        with np.errstate(over="ignore"):
            keys[own] = np.add.reduceat(_mix(word_key + (np.arange(len(first)) - begin[np.searchsorted(own, owner_line)]).astype(np.uint64) * np.uint64(0x9E3779B9)), begin)

    good = np.flatnonzero(solid)
    firsts, lasts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(first):
        firsts[owner_line[::-1]] = kind[first[::-1]]
        lasts[owner_line] = ends
    columns = {
        "length": _log(solid, 3), "words": _log(words, 3), "letters": _share(letters, solid), "upper": _share(counts[:, UPPER], letters), "digits": _share(counts[:, DIGIT], solid),
        "punctuation": _share(counts[:, PUNCTUATION] * 2, solid), "symbols": _share(counts[:, SYMBOL] * 2, solid), "other": _share(counts[:, OTHER] * 2, solid), "word_length": _log(solid / np.maximum(words, 1), 1.6),
        "distinct": _share(distinct, words), "stutter": _share(stutter, words), "commonest": _share(commonest, words), "odd_ends": _share(odd, words), "runs": _share(runs * 3, solid), "first": firsts, "last": lasts, "repeats": np.zeros(n),
    }
    steps = np.stack([columns[name] for name in FEATURES], axis=1).astype(np.uint8)
    # an empty text begins where the next one does: the last text that begins at or before a node has it
    text = np.searchsorted(begins, cuts, "right") - 1
    found = Lines(text[good], solid[good] + counts[good, SPACE], keys[good], steps[good])
    bare = np.setdiff1d(np.arange(len(begins)), found.owner) if blanks else found.owner[:0]
    if not len(bare):
        return found
    blank = Lines(bare, np.ones(len(bare), np.int64), np.zeros(len(bare), np.uint64), np.zeros((len(bare), len(FEATURES)), np.uint8))
    both = join([found, blank])
    return both.take(np.argsort(both.owner, kind="stable"))


#: Punctuation that prose does not end words in: &, %, *, #, @, \, _, / and the like.
_ODD = np.array([ord(c) for c in "&%*#@\\_/"], np.uint32)


def chain(lines: Lines) -> np.ndarray:
    """(lines, 3, features) steps of each line and of those before and after it in its text; STEPS beyond the edge."""
    n = len(lines.owner)
    steps = lines.steps.copy()
    for back in range(min(MEMORY, n - 1), 0, -1):
        same = (lines.key[back:] == lines.key[:-back]) & (lines.owner[back:] == lines.owner[:-back])
        steps[back:, -1][same] = 1 if back > 1 else 2
    out = np.full((n, 3, len(FEATURES)), STEPS, np.uint8)
    out[:, 1] = steps
    near = lines.owner[1:] == lines.owner[:-1]
    out[1:, 0][near] = steps[:-1][near]
    out[:-1, 2][near] = steps[1:][near]
    return out


@dataclass
class Model:
    weights: np.ndarray  # (3, features, STEPS + 1, 2)
    transitions: np.ndarray  # (2, 2), labels bad and good
    start: np.ndarray
    slope: float
    offset: float

    def emissions(self, nodes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(nodes), 2))
        for side in range(3):
            for f in range(len(FEATURES)):
                out += self.weights[side, f][nodes[:, side, f]]
        return out

    def calibrate(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(share) + self.offset)))


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def _firsts(owner: np.ndarray) -> np.ndarray:
    return np.r_[True, owner[1:] != owner[:-1]]


def weighted(owner: np.ndarray, size: np.ndarray, good: np.ndarray, texts: int) -> np.ndarray:
    """Mean of ``good`` over the lines of each text, weighted by length."""
    return np.bincount(owner, size * good, minlength=texts) / np.bincount(owner, size, minlength=texts)


def _platt(share: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic regression of the labels on the shares, by Newton's method with a small ridge."""
    x = np.stack([_logit(share), np.ones(len(share))], axis=1)
    beta, ridge = np.array([1.0, 0.0]), np.diag([1.0, 1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (label - p) - ridge @ (beta - [1.0, 0.0])
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, gradient)
    return float(max(beta[0], 0.05)), float(beta[1])


def train(samples: list[tuple[int, str]]) -> Model | None:
    """A model from (label, text) pairs: AdaGrad on the CRF's likelihood, with lines relabelled between rounds."""
    if not samples:
        return None
    label = np.array([q for q, _ in samples], np.int64)
    encoded = [t.encode("utf-8", "replace") for _, t in samples]
    begins = np.cumsum([0, *(len(e) for e in encoded[:-1])])
    lines = describe(np.frombuffer(b"".join(encoded), np.uint8), begins)
    nodes, first = chain(lines), _firsts(lines.owner)
    # the two classes weigh alike
    texts = len(samples)
    length = np.bincount(lines.owner, lines.size, minlength=texts)
    per_class = np.maximum(np.bincount(label, minlength=2), 1)
    weight = (texts / (2 * per_class[label]))[lines.owner]
    model = Model(np.zeros((3, len(FEATURES), STEPS + 1, 2)), np.zeros((2, 2)), np.zeros(2), 1.0, 0.0)
    state = [model.weights, model.transitions, model.start]
    squares = [np.full_like(s, 1e-6) for s in state]
    own = label[lines.owner].copy()
    inner = np.flatnonzero(~first)
    for round_ in range(ROUNDS):
        for _ in range(CLIMBS):
            emission = model.emissions(nodes)
            alpha, beta, share = forward_backward(emission, first, model.transitions, model.start)
            gap = -share
            gap[np.arange(len(own)), own] += 1
            gap *= weight[:, None]
            up = np.zeros_like(model.weights)
            for side in range(3) if round_ else (1,):
                for f in range(len(FEATURES)):
                    for c in range(2):
                        up[side, f, :, c] = np.bincount(nodes[:, side, f], gap[:, c], minlength=STEPS + 1)
            local = np.exp(emission[inner] - emission[inner].max(axis=1, keepdims=True)) * beta[inner]
            pair = alpha[inner - 1][:, :, None] * np.exp(model.transitions)[None] * local[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            moves = -(pair * weight[inner, None, None]).sum(axis=0)
            np.add.at(moves, (own[inner - 1], own[inner]), weight[inner])
            if not round_:
                moves[:] = 0
            for k, gradient in enumerate((up - DECAY * len(own) * model.weights, moves, gap[first].sum(axis=0))):
                squares[k] += gradient**2
                state[k] += RATE * gradient / np.sqrt(squares[k])
        if round_ + 1 < ROUNDS:
            own = _relabel(label[lines.owner], lines, share[:, 1], length)
    share = weighted(lines.owner, lines.size, forward_backward(model.emissions(nodes), first, model.transitions, model.start)[2][:, 1], texts)
    model.slope, model.offset = _platt(share, label)
    return model


def _relabel(label: np.ndarray, lines: Lines, good: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Labels of lines: good in good documents; in bad ones good where the model says so, less the worst part of each document."""
    order = np.lexsort((good, lines.owner))
    size = lines.size[order]
    before = np.cumsum(size) - size
    before -= before[np.flatnonzero(_firsts(lines.owner[order]))][np.cumsum(_firsts(lines.owner[order])) - 1]
    held = np.empty(len(order), bool)
    held[order] = before < LEAST_BAD * length[lines.owner[order]]
    return np.where((label == 0) & (held | (good < 0.5)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """A model from a bounded sample of the labelled rows for which ``training`` (over the id) holds: those of the least hash."""
    known = labels.select(F.col(id_col).alias("id"), F.col(quality_col).cast("int").alias("quality")).where("id is not null and quality in (0, 1)").distinct()
    known = known.join(docs.where(training).select(F.col(id_col).alias("id")), "id", "left_semi")
    known = stage(known.withColumn("spot", F.xxhash64("id")), "quality-labels")
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    # hashes up to this mark hold about twice the rows that are wanted, so few rows are ranked
    mark = F.lit(None).cast("long")
    for quality, n in sizes.items():
        mark = F.when(F.col("quality") == quality, F.lit(min(2**63 - 1, -(2**63) + int(2.0**64 * (2 * per_class + 64) / n)))).otherwise(mark)
    place = F.row_number().over(Window.partitionBy("quality").orderBy("spot", "id"))
    chosen = known.where(F.col("spot") <= mark).withColumn("place", place).where(F.col("place") <= per_class).select("id", "quality")
    text, own = fresh(docs, "text_", "id_")
    texts = docs.where(training).select(F.col(id_col).alias(own), F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, sample_chars).alias(text))
    rows = texts.join(small(stage(chosen, "quality-chosen"), 2 * per_class), F.col(own) == F.col("id"))
    # one text an id: the least
    rows = rows.groupBy("quality", "id").agg(F.min(text).alias(text)).collect()
    return train([(r["quality"], r[text]) for r in sorted(rows, key=lambda r: (r["quality"], r["id"]))])


def _sweep(model: Model, data: np.ndarray, block: int) -> tuple[float, int, float]:
    """Weighted share of good, number of lines and of bad ones for one text longer than a block."""
    edges = [0]
    while edges[-1] < len(data):
        low, high = edges[-1], edges[-1] + max(block, 2 * UNIT)
        if high >= len(data):
            edges.append(len(data))
            break
        ends = np.flatnonzero(data[low:high] == 10)
        if len(ends):
            edges.append(low + int(ends[-1]) + 1)
        else:  # a line longer than the block: end with a whole piece of it
            pieces = _cuts(data[low:high], np.zeros(1, np.int64))
            edges.append(low + int(pieces[-1]))
    spans = list(zip(edges[:-1], edges[1:], strict=True))

    def own(k: int) -> Lines:
        low, high = spans[k]
        return describe(data[low:high], np.zeros(1, np.int64), blanks=False)

    heads, tails, lengths = [], [], []
    for k in range(len(spans)):
        found = own(k)
        heads.append(found.take(slice(0, 1)))
        tails.append(found.take(slice(-MEMORY - 1, None)) if len(found.owner) else found)
        lengths.append(len(found.owner))
    used = [k for k, n in enumerate(lengths) if n]
    if not used:
        blank = describe(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        good = forward_backward(model.emissions(chain(blank)), np.ones(1, bool), model.transitions, model.start)[2][0, 1]
        return float(good), 1, float(good < 0.5)

    def emissions(j: int) -> tuple[Lines, np.ndarray]:
        """Lines of a block and their emissions, seen with the lines around the block."""
        before: list[Lines] = []
        for k in reversed(used[:j]):
            before.insert(0, tails[k])
            if sum(len(b.owner) for b in before) > MEMORY:
                break
        found = own(used[j])
        after = [heads[used[j + 1]]] if j + 1 < len(used) else []
        skip = sum(len(b.owner) for b in before)
        return found, model.emissions(chain(join([*before, found, *after]))[skip : skip + len(found.owner)])

    a = np.exp(model.transitions)
    starts, vector = [], None
    for j in range(len(used)):
        starts.append(model.start if vector is None else np.log(np.maximum(vector @ a, 1e-300)))
        _, emission = emissions(j)
        first = np.zeros(len(emission), bool)
        first[0] = True
        vector = forward_backward(emission, first, model.transitions, starts[-1])[0][-1]
    total, mass, bad, message = 0, 0.0, 0, None
    for j in range(len(used) - 1, -1, -1):
        found, emission = emissions(j)
        n = len(emission)
        if message is not None:
            emission = np.vstack([emission, message])
        first = np.zeros(len(emission), bool)
        first[0] = True
        _, beta, share = forward_backward(emission, first, model.transitions, starts[j])
        good = share[:n, 1]
        total, mass, bad = total + int(found.size.sum()), mass + float((found.size * good).sum()), bad + int((good < 0.5).sum())
        message = emission[0] + np.log(np.maximum(beta[0], 1e-300))
    return mass / total, sum(lengths), bad


def score_texts(model: Model, texts: pa.Array, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text (no nulls): weighted share of good, number of lines, number of bad lines."""
    n = len(texts)
    share, lines, bad = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    sizes = np.array([len(texts[k].as_buffer()) for k in range(n)], np.int64)
    low = 0
    while low < n:
        if sizes[low] > block:
            share[low], lines[low], bad[low] = _sweep(model, np.frombuffer(texts[low].as_buffer(), np.uint8), block)
            low += 1
            continue
        high = low
        while high < n and sizes[high] <= block and sizes[low : high + 1].sum() <= 2 * block:
            high += 1
        data = np.frombuffer(b"".join(texts[k].as_buffer().to_pybytes() for k in range(low, high)), np.uint8)
        found = describe(data, np.cumsum(np.r_[0, sizes[low : high - 1]]))
        good = forward_backward(model.emissions(chain(found)), _firsts(found.owner), model.transitions, model.start)[2][:, 1]
        share[low:high] = weighted(found.owner, found.size, good, high - low)
        lines[low:high] = np.bincount(found.owner, minlength=high - low)
        bad[low:high] = np.bincount(found.owner, good < 0.5, minlength=high - low)
        low = high
    return share, lines, bad


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, kept (the value of ``keep``), score, predicted, n_lines, n_bad_lines."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), (keep if keep is not None else F.lit(False)).alias("kept"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            share, lines, bad = np.full(batch.num_rows, 0.5), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            if shared.value is not None and batch.num_rows:
                share, lines, bad = score_texts(shared.value, batch.column(2))
                share = shared.value.calibrate(share)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(share, pa.float64()), pa.array((share >= threshold).astype(np.int32)), pa.array(lines), pa.array(bad)],
                names=["doc_id", "kept", "score", "predicted", "n_lines", "n_bad_lines"],
            )

    kind, flag = rows.schema["doc_id"].dataType.simpleString(), rows.schema["kept"].dataType.simpleString()
    return rows.mapInArrow(bounded(run), f"doc_id {kind}, kept {flag}, score double, predicted int, n_lines long, n_bad_lines long")


__all__ = ["Model", "fit", "fold", "predict", "score_texts", "train"]
