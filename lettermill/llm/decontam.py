"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are word sequences, made by the same function: split at Unicode
white space, outer punctuation removed, each word lower-cased by itself.  A passage leaks an item of L words when its word edit
distance to the item is at most ``floor(rate * L)``.

For every size L that items have, windows of L words are embedded by several
random walks of the CGK kind: at step j the current word is written out, and a
hash bit of (j, word) decides whether the walk moves on, so edit distance becomes
Hamming distance.  Each walk is sampled at a few positions per table; the items that
share a table entry with a window are its candidates, and nothing else is.  Every
candidate is then verified by the exact edit distance between the item and the best
stretch of text around the window.

How much of two embeddings agrees falls with the size and differs from pair to pair,
so :func:`plan` measures it for every size: random items lose as many words as the
limit allows (deletions are the hardest edits), and the cheapest number of tables,
bits a table and reach into the walk is taken whose expected recall meets ``recall``.

Where windows start is narrowed without loss first: k edits cannot touch all of
k + 1 disjoint segments of an item, so a leak holds one segment unchanged, and
only windows aligned to such a segment are embedded.

Items reach the executors in blocks of about ``block_items`` items and
``block_chars`` code points; documents are read once a block, nothing shuffles but
the matches found.

Defined cases: null and empty texts and items match nothing; items under
``min_words`` words match exactly (no edits); equal items are reported one by
one; repeated rows are reported each; of several leaks of one item in a text the
closest, then first, is returned; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, small_batches

RATE = 0.2
MIN_WORDS = 5
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
WALKS, RECALL = 8, 0.995
#: What a plan is chosen from: steps of the walk in item sizes, bits a table, tables; and how many pairs it is measured on.
REACHES, BITS, TABLES, MEASURED = (0.25, 0.5, 1.0, 2.0), (3, 2, 1), (8, 16, 32, 48, 64, 96, 128, 192, 256, 384), 96
#: A table of so many bits costs so much, for the chance meetings that must be verified.
COST = {3: 1.0, 2: 1.2, 1: 12.0}
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 of each element."""
    with np.errstate(over="ignore"):
        x = (x + _ODD).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def clean_word(word: str) -> str:
    """Lower-cased, without what is no letter or digit at either end."""
    low, high = 0, len(word)
    while low < high and not word[low].isalnum():
        low += 1
    while high > low and not word[high - 1].isalnum():
        high -= 1
    return word[low:high].lower()


def split_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text before they are cleaned."""
    return pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))


def words_of(text: str | None) -> list[str]:
    return [w for w in map(clean_word, split_words(pa.array([text], pa.string()))[0].as_py()) if w]


def embed(windows: np.ndarray, walk: int, steps: int | None = None) -> np.ndarray:
    """CGK embedding of each row of word codes: ``steps`` symbols, three times as many as words unless given, 0 past the end."""
    n, size = windows.shape
    steps = 3 * size if steps is None else steps
    padded = np.concatenate([windows, np.zeros((n, 1), windows.dtype)], axis=1)
    at, rows, out = np.zeros(n, np.int64), np.arange(n), np.empty((n, steps), windows.dtype)
    for j in range(steps):
        out[:, j] = word = padded[rows, at]
        bit = _mix(word.astype(np.uint64) ^ np.uint64((walk << 40) + (j << 20))) & np.uint64(1)
        at = np.minimum(at + bit.astype(np.int64), size)
    return out


@dataclass(frozen=True)
class Plan:
    """How windows of a size are sketched, and the recall expected at the edit limit."""

    steps: int
    bits: int
    tables: int
    recall: float


def edit_limit(size: int, rate: float, min_words: int) -> int:
    return math.floor(rate * size + 1e-9) if size >= min_words else 0


def shortened(size: int, edits: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A random item, and the windows aligned to its intact segments in a text that lacks ``edits`` of its words."""
    item = np.arange(1, size + 1, dtype=np.int64) + (int(rng.integers(1 << 30)) << 12)
    kept = np.setdiff1d(np.arange(size), rng.choice(size, edits, replace=False))
    text = np.concatenate([rng.integers(1 << 50, 1 << 60, size), item[kept], rng.integers(1 << 50, 1 << 60, size)])
    length = size // (edits + 1)
    first = np.arange(0, length * (edits + 1), length)
    at = np.searchsorted(kept, first)
    whole = (at + length <= len(kept)) & (kept[np.minimum(at + length - 1, len(kept) - 1)] == first + length - 1) & (kept[np.minimum(at, len(kept) - 1)] == first)
    starts = np.unique(size + at[whole] - first[whole])
    return item, text[starts[:, None] + np.arange(size)]


@cache
def plan(size: int, edits: int, recall: float = RECALL) -> Plan:
    """The cheapest sketches of a size whose expected recall at ``edits`` deletions meets ``recall``; else the best ones."""
    if not edits:
        return Plan(2 * size, BITS[0], 1, 1.0)
    rng, reaches = np.random.default_rng(size), sorted({max(1, round(r * size)) for r in REACHES})
    measured = max(MEASURED // 4, min(MEASURED, 20_000 // size))
    pairs = [shortened(size, edits, rng) for _ in range(measured)]
    stack = np.concatenate([np.vstack([item[None], windows]) for item, windows in pairs])
    low = np.cumsum([0, *(1 + len(windows) for _, windows in pairs)])
    agree = {steps: [] for steps in reaches}  # for each walk, for each window: share of the first steps that agree
    for walk in range(WALKS):
        embedded = embed(stack, walk, reaches[-1])
        same = np.concatenate([embedded[a + 1 : b] == embedded[a] for a, b in zip(low[:-1], low[1:], strict=True)])
        for steps in reaches:
            agree[steps].append(same[:, :steps].mean(axis=1))
    begins = low[:-1] - np.arange(measured)
    found = []
    for steps, rates in agree.items():
        for bits in BITS:
            miss = np.log(np.maximum(1 - np.stack(rates) ** bits, 1e-12)).sum(axis=0) / WALKS  # a table's, for each window
            best = np.minimum.reduceat(miss, begins)  # of a leak's windows the likeliest
            found += [(Plan(steps, bits, tables, float(1 - np.exp(best * tables).mean())), tables * COST[bits]) for tables in TABLES]
    enough = [(cost, -p.recall, p.steps, p) for p, cost in found if p.recall >= recall]
    return min(enough, key=lambda x: x[:3])[-1] if enough else max((p for p, _ in found), key=lambda p: p.recall)


def planned(size: int, rate: float, min_words: int, recall: float) -> Plan:
    """:func:`plan` of the next of few sizes, about a tenth apart, fitted to this one."""
    step = max(1, 1 << max(0, size.bit_length() - 4))
    upper = -(-size // step) * step
    edits = edit_limit(size, rate, min_words)
    if not edits:
        return plan(size, 0, recall)
    found = plan(upper, edit_limit(upper, rate, min_words), recall)
    return Plan(max(1, found.steps * size // upper), found.bits, found.tables, found.recall)


def sketch(windows: np.ndarray, how: Plan) -> np.ndarray:
    """(rows, tables) hashes of sampled embedding positions."""
    n, size = windows.shape
    out = np.empty((n, how.tables), np.uint64)
    rng = np.random.default_rng(size)
    for walk in range(min(WALKS, how.tables)):
        embedded = embed(windows, walk, how.steps)
        spots = rng.integers(0, how.steps, (len(range(walk, how.tables, WALKS)), how.bits))
        for table, spot in zip(range(walk, how.tables, WALKS), spots, strict=True):
            key = np.full(n, table, np.uint64)
            for s in spot:
                key = _mix(key ^ embedded[:, s].astype(np.uint64))
            out[:, table] = key
    return out


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to any stretch of the text: (distance, start, stop)."""
    n = len(text)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for i, word in enumerate(item, 1):
        diagonal = cost[:-1] + (text != word)
        up = cost[1:] + 1
        new, born = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], born[0] = i, 0
        new[1:] = np.minimum(diagonal, up)
        born[1:] = np.where(diagonal <= up, start[:-1], start[1:])
        # moves along the text: new[j] = min over h <= j of new[h] + (j - h)
        slack = new - np.arange(n + 1)
        low = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == low, np.arange(n + 1), 0))
        cost, start = low + np.arange(n + 1), born[source]
    stop = int(np.argmin(cost))
    return int(cost[stop]), int(start[stop]), stop


@dataclass
class _Size:
    """The items of one size: word codes, ids, and the sorted entries of every table."""

    items: np.ndarray
    ids: list
    edits: int
    how: Plan
    entries: list[tuple[np.ndarray, np.ndarray]]


@dataclass
class Index:
    """What a block of items needs: vocabulary, segments, tables."""

    vocabulary: pa.Array
    sizes: dict[int, _Size] = field(default_factory=dict)
    segments: dict[int, tuple[np.ndarray, ...]] = field(default_factory=dict)  # length -> sorted hash, size, offset


def rolling(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` codes."""
    out = np.zeros(max(0, len(codes) - length + 1), np.uint64)
    for j in range(length):
        out = _mix(out ^ codes[j : j + len(out)].astype(np.uint64))
    return out


def build(items: list[tuple[int, str | None]], rate: float, min_words: int, recall: float) -> Index:
    sequences = [(i, words_of(t)) for i, t in items]
    words = sorted({w for _, s in sequences for w in s})
    code = {w: k + 1 for k, w in enumerate(words)}
    index, by_size, found = Index(pa.array(words, pa.string())), defaultdict(list), defaultdict(set)
    for i, s in sequences:
        if s:
            by_size[len(s)].append((i, np.array([code[w] for w in s], np.int64)))
    for size, own in by_size.items():
        edits, how = edit_limit(size, rate, min_words), planned(size, rate, min_words, recall)
        grid = np.stack([s for _, s in own])
        keys = sketch(grid, how)
        entries = []
        for t in range(how.tables):
            order = np.argsort(keys[:, t], kind="stable")
            entries.append((keys[order, t], order))
        index.sizes[size] = _Size(grid, [i for i, _ in own], edits, how, entries)
        length = size // (edits + 1)
        for _, s in own:
            for offset in range(0, length * (edits + 1), length):
                found[length].add((int(rolling(s[offset : offset + length], length)[0]), size, offset))
    for length, rows in found.items():
        rows = sorted(rows)
        index.segments[length] = (np.array([r[0] for r in rows], np.uint64), *(np.array([r[c] for r in rows]) for c in (1, 2)))
    return index


def aligned(index: Index, codes: np.ndarray) -> dict[int, np.ndarray]:
    """For each size the starts of windows that are aligned to an intact segment of an item, sorted.

    A segment has words of the items only, so runs with another word (code 0) are
    passed over before anything is hashed.
    """
    known = np.concatenate([[0], np.cumsum(codes > 0)])
    out = defaultdict(list)
    for length, (hashes, sizes, offsets) in index.segments.items():
        spots = np.flatnonzero(known[length:] - known[:-length] == length)
        if not len(spots):
            continue
        runs = np.zeros(len(spots), np.uint64)
        for j in range(length):
            runs = _mix(runs ^ codes[spots + j].astype(np.uint64))
        low, high = np.searchsorted(hashes, runs), np.searchsorted(hashes, runs, "right")
        count = high - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        starts = np.repeat(spots, count) - offsets[at]
        for size in np.unique(sizes[at]).tolist():
            out[size].append(starts[sizes[at] == size])
    return {size: np.unique(np.concatenate(own)) for size, own in out.items()}


def search(index: Index, codes: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item id) -> (distance, start, stop) of the leaks in texts that lie one after another, each closed by a 0."""
    best = {}
    for size, starts in aligned(index, codes).items():
        own = index.sizes[size]
        # a window belongs to the text of its middle, which its segment is nearest to
        text = np.searchsorted(ends, np.clip(starts + size // 2, 0, len(codes) - 1), "right")
        low, high = np.concatenate([[0], ends])[text], ends[text] - 1
        for own_text in (0, -1, 1):
            # a window that sticks out of a text by more than half is tried for its neighbour as well
            where = text + own_text
            fits = (where >= 0) & (where < len(ends))
            if own_text:
                fits &= (starts < low) if own_text < 0 else (starts + size > high)
            if fits.any():
                _verify(own, codes, ends, size, starts[fits], where[fits], best)
    return best


def candidates(own: _Size, grid: np.ndarray) -> list[tuple[int, int]]:
    """(window, item row) that share a table entry."""
    keys, pairs = sketch(grid, own.how), []
    for t, (entries, order) in enumerate(own.entries):
        first, last = np.searchsorted(entries, keys[:, t]), np.searchsorted(entries, keys[:, t], "right")
        count = last - first
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        pairs.append(np.repeat(np.arange(len(grid)), count) * len(own.ids) + order[at])
    return [divmod(int(p), len(own.ids)) for p in np.unique(np.concatenate(pairs))]


def _verify(own: _Size, codes: np.ndarray, ends: np.ndarray, size: int, starts: np.ndarray, text: np.ndarray, best: dict) -> None:
    """Candidates of windows by their sketches, then the exact distance inside the window's text."""
    low, high = np.concatenate([[0], ends])[text], ends[text] - 1
    for at in range(0, len(starts), 4096):
        part = slice(at, at + 4096)
        spots = starts[part, None] + np.arange(size)
        inside = (spots >= low[part, None]) & (spots < high[part, None])
        grid = np.where(inside, codes[np.clip(spots, 0, len(codes) - 1)], 0)
        for w, k in candidates(own, grid):
            bottom, top, start = int(low[at + w]), int(high[at + w]), int(starts[at + w])
            begin = max(bottom, start - own.edits)
            around = codes[begin : max(begin, min(top, start + size + own.edits))]
            # all but ``edits`` words of a leaked item are in the stretch
            if np.isin(own.items[k], around).sum() < size - own.edits:
                continue
            distance, a, b = best_stretch(own.items[k], around)
            if distance <= own.edits:
                found = (distance, begin + a - bottom, begin + b - bottom)
                key = (int(text[at + w]), own.ids[k])
                best[key] = min(best.get(key, found), found)


def text_codes(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all texts, a 0 after each, and where each ends: 0 for words that no item has; words without letters or digits are left out."""
    split = split_words(texts)
    words = pc.dictionary_encode(split.flatten())
    distinct = [w.lower() if w.isalnum() else clean_word(w) for w in words.dictionary.to_pylist()]
    table = pc.fill_null(pc.index_in(pa.array(distinct, pa.string()), vocabulary), -1).to_numpy().astype(np.int64) + 1
    blank = np.array([not w for w in distinct], bool)
    code = words.indices.to_numpy() if len(words) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    full = ~blank[code] if len(code) else np.zeros(0, bool)
    owner, code = owner[full], code[full]
    sizes = np.bincount(owner, minlength=len(texts)) + 1
    ends = np.cumsum(sizes)
    codes = np.zeros(int(sizes.sum()), np.int64)
    inner = np.ones(len(codes), bool)
    inner[ends - 1] = False
    codes[inner] = table[code] if len(code) else 0
    return codes, ends


_MATCH = "item_id long, distance int, start_word long, n_words int"


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, min_words: int = MIN_WORDS, recall: float = RECALL, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, distance, start_word, n_words."""
    spark = small_batches(docs.sparkSession)
    items = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    amount = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    blocks = max(1, math.ceil(amount["n"] / block_items), math.ceil(amount["chars"] / block_chars))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in range(blocks):
        own = [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()]
        index = spark.sparkContext.broadcast(build(own, rate, min_words, recall))

        def run(batches, index=index):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                leaks = search(index.value, *text_codes(batch.column(1), index.value.vocabulary)) if ids else {}
                found = [(ids[text], item, d, a, b - a) for (text, item), (d, a, b) in sorted(leaks.items(), key=str)]
                columns = list(zip(*found, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "start_word", "n_words"])

        part = rows.mapInArrow(bounded(run), "doc_id long, " + _MATCH)
        out = part if out is None else out.unionByName(part)
    return out
