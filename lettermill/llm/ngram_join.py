"""Exact Jaccard self-join of word n-gram sets by universe partitioning.

A document's set holds the hashes of its distinct five-word shingles; documents
with the same set are one set from the start.  Two sets link when their Jaccard
similarity is at least 0.75, so they differ in at most (|R| + |S|) / 7 elements.

* Size bands.  Sizes are cut into bands a factor 4/3 wide, so linked sets lie in
  the same or in neighbouring bands.  A set is signed for its own band and for
  the band below.
* Segments.  A band hashes the universe into m segments.  As a difference spoils
  one segment at most, a pair shares all segments that its differences leave
  alone: more than none whenever a set fills more segments than it can differ in.
* Cost-based allocation.  m minimises the expected number of signatures: few
  segments give few signatures, but more sets that fill too few of them.
* One-deletion neighbourhoods.  A set that fills too few also signs every segment
  of two and more elements less one element, which covers two differences there,
  and, if that is still too little, a partition four times as fine, and so on.
  A pair is missed by a level only if it is too little for both sets, and then
  both sign the next level.

Signatures travel as packed binary blocks to buckets, are sorted there, and give
pairs with the number of segments they share.  A pair must share at least (filled
segments - possible differences), which discards nearly all pairs that only have
a common passage, before any set is read.  Signatures of more than two sets are not
paired at first, but one row each, and equal groups are one.  They connect each set
with one pivot; once these stars are verified and hot signatures compared (below), a group gives the pairs whose ends are
in different components, so a family of copies that the stars join gives none.
Signatures that more than ``HOT`` sets have are never paired: a set has more filled
segments than it needs, so its most frequent ones are left out first (a pair still
meets in the others); where hot ones are needed they connect the sets with one pivot
each, and only sets that end in different components are compared further, in blocks
through an inverted index.

Pairs are compared a bundle of connected candidates at a time, so that each set
travels once: first as a bitmap of the bins it fills, where too many bins that only
one set fills rule a link out, then, in what is left, exactly.  Pairs inside one
component are left out, as they cannot change it.  A bundle too large for a task is
cut into blocks of classes.
Components come from alternating large-star and small-star rounds over staged
tables; links that a count shows to fit in one task are joined there instead.

Defined cases: without words or text a set is empty and links with nothing; with
fewer than five words the whole sequence is the one shingle; repeated rows are one
set; a null id takes part and never is the smallest unless all are null; extra
columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, fresh, release, row_key, small, small_batches, stage

WORDS = 5
HOT = 32
BUCKET_SIGNATURES = 5_000_000
BLOCK_WORDS = 1 << 20
PAIRS_AT_ONCE = 300_000
#: Bytes of a signature that travel beside its bucket; the rest of 8 bytes holds its set's place when they are sorted.
SIGN_BYTES = 5
#: Candidate bundles of up to so many bytes and sets are compared in one task.
BUNDLE_BYTES, BUNDLE_SETS = 48 << 20, 16_384
#: The components of up to so many links (16 bytes each) are found in one task.
TASK_LINKS = 2_000_000
MAX_BROADCAST = 1_000_000
OUTSIDERS, MEMBER_ELEMENTS = 256, 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# sets


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))[full]
    encoded = pc.dictionary_encode(flat.filter(pa.array(full)))
    table = np.array([xxhash.xxh64_intdigest(w) for w in encoded.dictionary.to_pylist()], np.uint64)
    hashes = table[encoded.indices.to_numpy()] if len(encoded) else np.zeros(0, np.uint64)
    sizes = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(sizes)
    runs = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words):
            runs = (runs ^ hashes[j : j + len(runs)]) * _ODD
            runs ^= runs >> np.uint64(29)
        runs = mix(runs)
        out = []
        for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
            if size >= words:
                out.append(np.unique(runs[end - size : end - words + 1]))
            elif size:
                out.append(np.array([xxhash.xxh64_intdigest(hashes[end - size : end].tobytes(), seed=size)], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_id(elements: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(elements.tobytes())).astype(np.int64))


# segments


def _cost(low: int, high: int, m: int) -> float:
    """Expected signatures of the largest set of a band cut into m segments."""
    n, p = high, 1 / m
    filled = m * (1 - (1 - p) ** n)
    spread = math.sqrt(max(1e-9, m * (1 - p) ** n * (1 - (1 + n * p) * (1 - p) ** n))) if m > 1 else 1e-9
    short = 0.5 * math.erfc((filled - 0.5 - n // 3) / spread / math.sqrt(2))
    return filled + short * 5 * n


@functools.lru_cache(maxsize=None)
def band(number: int) -> tuple[int, int, int]:
    """(smallest size, largest size, segments) of a band."""
    low = 1 if number == 0 else band(number - 1)[1] + 1
    high = max(low, low * 4 // 3)
    choices = [max(2, math.ceil(low * f / 20)) for f in (9, 10, 11, 12, 13, 14, 16, 20, 30, 40, 80, 160, 320)]
    return low, high, min(choices, key=lambda m: _cost(low, high, m))


def band_of(size: int) -> int:
    number = 0
    while band(number)[1] < size:
        number += 1
    return number


def signatures(elements: np.ndarray, number: int, most: int) -> tuple[np.ndarray, int]:
    """Signatures of a set for a band when it can differ in ``most`` elements, and how many segments it fills.

    The segments filled are 0 where the first level is too little for the set.
    """
    m, level, found, covered, filled = band(number)[2], 0, [], 0, 0
    weights = mix(elements + _ODD)
    while covered <= most:
        segment = ((elements >> np.uint64(32)) * np.uint64(min(m, 1 << 31))) >> np.uint64(32) if level < 12 else elements
        edge = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        count = np.diff(np.r_[edge, len(elements)])
        with np.errstate(over="ignore"):
            name = mix(segment[edge] * _ODD + np.uint64((number << 8) + level + 1))
            total = np.add.reduceat(weights, edge)
            found.append(mix(total ^ name))
            covered = len(edge)
            if covered > most:
                filled = 0 if level else covered
                break
            inside = np.repeat(count >= 2, count)
            found.append(mix((np.repeat(total, count) - weights)[inside] ^ np.repeat(name, count)[inside]))
        covered += int((count >= 2).sum())
        m, level = m * 4, level + 1
    return np.unique(np.concatenate(found)), filled


def possible_differences(size: int, own_band: bool) -> int:
    """How many elements a set of that size can differ in from a partner of its own band or above, or below."""
    return size // 3 if own_band else 2 * size // 7


# signing and matching

_PACKED = pa.schema([("bucket", pa.int32()), ("sets", pa.binary()), ("signatures", pa.binary()), ("doc_id", pa.int64()), ("set_id", pa.int64()), ("n", pa.int32())])
_ENTRY = np.dtype([("set", "<i8"), ("n", "<i4"), ("filled", "<i4")])


def _sign(buckets: int):
    def run(batches):
        seen, entries, signs, owners, size = set(), [], [], [], 0

        def flush():
            table, sign = np.array(entries, _ENTRY), np.concatenate(signs)
            owner = np.repeat(np.arange(len(signs), dtype=np.int64), [len(s) for s in signs])
            bucket = (sign % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            present = np.flatnonzero(np.diff(edges))
            packed, sets = [], []
            for b in present.tolist():
                chosen = order[edges[b] : edges[b + 1]]
                own, code = np.unique(owner[chosen], return_inverse=True)
                short = sign[chosen].view(np.uint8).reshape(-1, 8)[:, 8 - SIGN_BYTES :]
                packed.append(short.tobytes() + code.astype("<u4" if len(own) > 65536 else "<u2").tobytes())
                sets.append(table[own].tobytes())
            n = len(packed)
            return pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), pa.array(sets, pa.binary()), pa.array(packed, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], schema=_PACKED)

        at = TaskContext.get().partitionId() % buckets
        for batch in batches:
            ids = []
            for elements in shingle_sets(batch.column(1)):
                ids.append((set_id(elements), len(elements)))
                if len(elements) and ids[-1][0] not in seen:
                    seen.add(ids[-1][0])
                    number = band_of(len(elements))
                    for own in (True, False)[: 1 + bool(number)]:
                        sign, filled = signatures(elements, number if own else number - 1, possible_differences(len(elements), own))
                        entries.append((ids[-1][0], len(elements), filled if own else -filled))
                        signs.append(sign)
                        size += len(sign)
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([at] * n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), batch.column(0), pa.array([i for i, _ in ids], pa.int64()), pa.array([k for _, k in ids], pa.int32())], schema=_PACKED)
            if size >= BLOCK_WORDS:
                yield flush()
                seen, entries, signs, size = set(), [], [], 0
        if signs:
            yield flush()

    return run


_MATCH = "kind int, doc_id long, set_id long, n int, other long, shared int, need int, members array<long>, slacks array<int>, sizes array<int>"
_MATCH_ARROW = pa.schema([
    ("kind", pa.int32()), ("doc_id", pa.int64()), ("set_id", pa.int64()), ("n", pa.int32()), ("other", pa.int64()), ("shared", pa.int32()), ("need", pa.int32()),
    ("members", pa.list_(pa.int64())), ("slacks", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())),
])
DOCUMENT, PAIR, GROUP, CLIQUE = 0, 1, 2, 3


def _rows(kind: int, rows: int, **columns) -> pa.RecordBatch:
    full = {"kind": pa.array(np.full(rows, kind, np.int32)), **columns}
    return pa.RecordBatch.from_arrays([full[f.name] if f.name in full else pa.nulls(rows, f.type) for f in _MATCH_ARROW], schema=_MATCH_ARROW)


def _grouped(x: np.ndarray, y: np.ndarray, shared: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row per pair: the sum of what is shared, the most that is needed."""
    if not len(x):
        return x, y, shared, need
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    return x[first], y[first], np.add.reduceat(shared[order], first), np.maximum.reduceat(need[order], first)


def _shared(sets: np.ndarray, size: np.ndarray, filled: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs whose sizes allow a link, how many signatures they share here, and how many a link needs in all."""
    fits = 4 * np.minimum(size[a], size[b]) >= 3 * np.maximum(size[a], size[b])
    a, b = a[fits], b[fits]
    need = np.where((filled[a] > 0) & (filled[b] > 0), np.maximum(filled[a], filled[b]) - (size[a] + size[b]) // 7, 1)
    return _grouped(sets[a], sets[b], np.ones(len(a), np.int64), np.maximum(1, need))


def _cliques(sets: np.ndarray, size: np.ndarray, filled: np.ndarray) -> pa.RecordBatch:
    """Groups of one size, a row each: named by their sets and roles, ``shared`` counts the signatures of equal groups, the slacks are what their sets fill."""
    g = sets.shape[1]
    name = np.full(len(sets), g, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(g):
            name = mix((name ^ sets[:, j].astype(np.uint64)) * _ODD + filled[:, j].astype(np.int64).astype(np.uint64))
    name, first, times = np.unique(name, return_index=True, return_counts=True)
    ends = pa.array(np.arange(len(first) + 1, dtype=np.int32) * g)
    lists = lambda x, kind: pa.ListArray.from_arrays(ends, pa.array(x[first].ravel().astype(kind)))
    return _rows(
        CLIQUE, len(first), set_id=pa.array(name.view(np.int64)), n=pa.array(np.full(len(first), g, np.int32)), shared=pa.array(times, pa.int32()),
        members=lists(sets, np.int64), slacks=lists(np.abs(filled), np.int32), sizes=lists(size, np.int32),
    )


def _match(batches):
    """Documents pass; the signatures of each bucket become pairs with counts, groups of a few sets, and groups of more than ``HOT``."""
    held: dict[int, list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        plain = batch.filter(pc.is_null(batch.column(1)))
        if plain.num_rows:
            yield _rows(DOCUMENT, plain.num_rows, doc_id=plain.column(3), set_id=plain.column(4), n=plain.column(5))
        for bucket, sets, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if sets is not None:
                held.setdefault(bucket, []).append((sets, packed))
    while held:
        yield from _match_bucket(held.popitem()[1])


def _match_bucket(blocks: list[tuple[bytes, bytes]], most_sets: int = 1 << (8 * (8 - SIGN_BYTES))):
    """The pairs and groups of a bucket; the places of more than ``most_sets`` sets do not fit beside their signatures and are sorted along."""
    shift, base, at = np.uint64(8 * (8 - SIGN_BYTES)), 0, 0
    widths = [4 if len(sets) > 65536 * _ENTRY.itemsize else 2 for sets, _ in blocks]
    key = np.zeros(sum(len(packed) // (SIGN_BYTES + width) for (_, packed), width in zip(blocks, widths, strict=True)), np.uint64)
    wide = sum(len(sets) for sets, _ in blocks) > most_sets * _ENTRY.itemsize
    place, tables = np.zeros(len(key) if wide else 0, np.int64), []
    while blocks:
        (sets, packed), width = blocks.pop(), widths.pop()
        n = len(packed) // (SIGN_BYTES + width)
        part = key[at : at + n]
        part.view(np.uint8).reshape(n, 8)[:, 8 - SIGN_BYTES :] = np.frombuffer(packed, np.uint8, SIGN_BYTES * n).reshape(n, SIGN_BYTES)
        own = np.frombuffer(packed, f"<u{width}", n, SIGN_BYTES * n).astype(np.uint64) + np.uint64(base)
        if wide:
            place[at : at + n] = own.astype(np.int64)
        else:
            part |= own
        tables.append(np.frombuffer(sets, _ENTRY))
        base, at = base + len(tables[-1]), at + n
    table = np.concatenate(tables)
    del tables
    if wide:
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
    else:
        key.sort()
    sign = key >> shift
    again = np.zeros(len(sign), bool)
    same = sign[1:] == sign[:-1]
    again[1:] |= same
    again[:-1] |= same
    sign, code = sign[again], place[again] if wide else (key[again] & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
    if not len(sign):
        return
    own = table["set"][code]
    order = np.lexsort((own, sign))
    sign, code, own = sign[order], code[order], own[order]
    new = np.r_[True, (sign[1:] != sign[:-1]) | (own[1:] != own[:-1])]  # copies in several blocks count once
    sign, code, own = sign[new], code[new], own[new]
    edge = np.flatnonzero(np.r_[True, sign[1:] != sign[:-1]])
    count = np.diff(np.r_[edge, len(sign)])
    size, filled, lower = table["n"].astype(np.int64), np.abs(table["filled"]).astype(np.int64), table["filled"] < 0

    two = edge[count == 2]
    found = [_shared(table["set"], size, filled, code[part], code[part + 1]) for part in (two[low : low + PAIRS_AT_ONCE] for low in range(0, len(two), PAIRS_AT_ONCE))]
    if found:
        x, y, shared, need = (np.concatenate(c) for c in zip(*found, strict=True))
        x, y, shared, need = _grouped(x, y, shared, need)
        for low in range(0, len(x), 100_000):
            part = slice(low, low + 100_000)
            yield _rows(PAIR, len(x[part]), set_id=pa.array(x[part]), other=pa.array(y[part]), shared=pa.array(shared[part], pa.int32()), need=pa.array(need[part], pa.int32()))
    for g in range(3, HOT + 1):
        starts = edge[count == g]
        step = max(1, PAIRS_AT_ONCE // g)
        for low in range(0, len(starts), step):
            grid = starts[low : low + step, None] + np.arange(g)
            yield _cliques(own[grid], size[code[grid]], table["filled"][code[grid]])
    # how many of its filled segments a set can leave out, 0 where it has none to spare
    most = np.where(lower, 2 * size // 7, size // 3)
    slack = np.maximum(0, filled - most - 1)
    for start, g in zip(edge[count > HOT].tolist(), count[count > HOT].tolist(), strict=True):
        part = slice(start, start + g)
        # the sign of the slack tells the two roles of a set apart
        slacks = np.where(lower[code[part]], -slack[code[part]] - 1, slack[code[part]])
        yield _rows(GROUP, 1, set_id=pa.array([int(sign[start].astype(np.int64))], pa.int64()), n=pa.array([g], pa.int32()), members=pa.array([own[part]], pa.list_(pa.int64())), slacks=pa.array([slacks], pa.list_(pa.int32())))


# components


def _joined(batches):
    """(node, root) of all links of a task, by joining trees whose roots are their smallest nodes."""
    chunks = [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]) for batch in batches]
    if chunks:
        u, v = np.concatenate(chunks, axis=1)
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = np.arange(len(nodes))
        low, high = at[: len(u)], at[len(u) :]
        while True:
            a, b = root[low], root[high]
            apart = a != b
            if not apart.any():
                break
            low, high = low[apart], high[apart]
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while not np.array_equal(root, up := root[root]):
                root = up
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["node", "root"])
    release()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of undirected links (a, b) but the roots; a root is its component's smallest node."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc-edges")
    while True:
        if edges.count() <= TASK_LINKS:
            return stage(edges.coalesce(1).mapInArrow(_joined, "node long, root long"), "cc-roots")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "cc-least")
        large = stage(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = stage(small, "cc-small")
        if edges.exceptAll(small).isEmpty() and small.exceptAll(edges).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = small


# verification


def _with_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(set_id, elements) of the wanted sets, read again from one document each."""
    ids = wanted.select(F.col("doc_id").alias("wanted_id"))
    if wanted.count() <= MAX_BROADCAST:
        ids = F.broadcast(ids)

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(0), words)
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "elements"])

    texts = docs.join(ids, docs["doc_id"].eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
    sets = stage(texts.mapInArrow(bounded(run), "set_id long, elements binary"), "join-sets")
    # only rows that share an id, or have none, give a set twice
    once = sets.agg(F.count(F.lit(1)) == F.count_distinct("set_id")).first()[0]
    return sets if once else stage(sets.dropDuplicates(["set_id"]), "join-sets")


def _find(root: dict[int, int], x: int) -> int:
    while root.setdefault(x, x) != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _join_roots(root: dict[int, int], a: int, b: int) -> bool:
    """Whether a and b were in different trees, which are one now."""
    a, b = _find(root, a), _find(root, b)
    root[b] = a
    return a != b


def _verify_bundle(table: pa.Table) -> pa.Table:
    """A spanning forest of the links among the candidate pairs of a bundle."""
    root: dict[int, int] = {}
    nodes, others, raw = (table.column(c).to_pylist() for c in ("node", "other", "data"))
    sets = {n: np.frombuffer(x, np.uint64) for n, o, x in zip(nodes, others, raw, strict=True) if o is None}
    links = []
    for a, b in sorted((n, o) for n, o in zip(nodes, others, strict=True) if o is not None):
        if _find(root, a) != _find(root, b):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                _join_roots(root, a, b)
                links.append((a, b))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def bitmap(elements: np.ndarray) -> bytes:
    """How many elements, and which of at least four times as many bins have any."""
    bins = max(64, 1 << (4 * len(elements) - 1).bit_length())
    bits = np.zeros(bins, np.uint8)
    bits[(elements >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)] = 1
    return np.uint32(len(elements)).tobytes() + np.packbits(bits).tobytes()


def _may_link(x: bytes, y: bytes) -> bool:
    """Whether the bins that only one of two sets fills are no more than the elements linked sets can differ in."""
    a, b = np.frombuffer(x, np.uint8, offset=4), np.frombuffer(y, np.uint8, offset=4)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = np.packbits(np.unpackbits(a).reshape(-1, 2).any(axis=1))
    sizes = int.from_bytes(x[:4], "little") + int.from_bytes(y[:4], "little")
    return int(np.bitwise_count(a ^ b).sum()) <= sizes // 7


def _screen_bundle(table: pa.Table) -> pa.Table:
    """The pairs of a bundle that their bitmaps allow to link."""
    nodes, others, raw = (table.column(c).to_pylist() for c in ("node", "other", "data"))
    maps = {n: x for n, o, x in zip(nodes, others, raw, strict=True) if o is None}
    kept = [(n, o) for n, o in zip(nodes, others, strict=True) if o is not None and _may_link(maps[n], maps[o])]
    return pa.table({"a": pa.array([a for a, _ in kept], pa.int64()), "b": pa.array([b for _, b in kept], pa.int64())})


def _bundled(pairs: DataFrame, data: DataFrame, compare) -> DataFrame:
    """``compare`` over bundles of connected pairs with the data (set_id, data) of their sets.

    A bundle of more than ``BUNDLE_BYTES`` or ``BUNDLE_SETS`` is cut into k classes of sets by hash, and
    its pairs into the k * k blocks of the classes of their ends: a set travels to
    the 2 k - 1 blocks of its class instead of once a pair.
    """
    bundles = components(pairs)
    whole = bundles.union(bundles.select(F.col("root").alias("node"), "root").distinct())
    width = data.select(F.col("set_id").alias("node"), F.octet_length("data").alias("n"))
    classes = whole.join(width, "node").groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / BUNDLE_BYTES), F.ceil(F.count(F.lit(1)) / BUNDLE_SETS)).cast("int").alias("k"))
    placed = stage(whole.join(classes, "root"), "join-bundles")
    placed = placed if placed.count() > MAX_BROADCAST else F.broadcast(placed)
    class_of = lambda x: F.pmod(F.xxhash64(x), F.col("k")).cast("int")
    inner = pairs.join(placed.select(F.col("node").alias("a"), "root", "k"), "a")
    inner = inner.select("root", class_of("a").alias("i"), class_of("b").alias("j"), F.col("a").alias("node"), F.col("b").alias("other"), F.lit(None).cast("binary").alias("data"))
    every, own = F.sequence(F.lit(0), F.col("k") - 1), class_of("node")
    places = F.array_distinct(F.concat(F.transform(every, lambda t: F.struct(own.alias("i"), t.alias("j"))), F.transform(every, lambda t: F.struct(t.alias("i"), own.alias("j")))))
    given = data.join(placed, data["set_id"] == placed["node"]).select("root", "node", "data", F.explode(places).alias("p"))
    given = given.select("root", "p.i", "p.j", "node", F.lit(None).cast("long").alias("other"), "data")
    return stage(inner.unionByName(given).groupBy("root", "i", "j").applyInArrow(compare, "a long, b long"), "join-bundle")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """A spanning forest of the links among the pairs: screened by bitmaps of half a byte an element, then verified."""

    def run(batches):
        for batch in batches:
            maps = [bitmap(np.frombuffer(x, np.uint64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], names=["set_id", "data"])

    maps = stage(sets.mapInArrow(bounded(run), "set_id long, data binary"), "join-maps")
    left = _bundled(pairs, maps, _screen_bundle)
    return _bundled(left, sets.withColumnRenamed("elements", "data"), _verify_bundle)


def _needed_groups(groups: DataFrame) -> DataFrame:
    """(sign, node): hot signatures that a set cannot leave out; its most frequent ones go first."""
    each = groups.select(F.col("set_id").alias("sign"), F.col("n").alias("frequency"), F.explode(F.arrays_zip("members", "slacks")).alias("m"))
    each = each.select("sign", "frequency", F.col("m.members").alias("node"), (F.col("m.slacks") < 0).alias("lower"), F.when(F.col("m.slacks") < 0, -F.col("m.slacks") - 1).otherwise(F.col("m.slacks")).alias("slack"))
    rank = F.row_number().over(Window.partitionBy("node", "lower").orderBy(F.desc("frequency"), "sign"))
    return each.withColumn("rank", rank).where("rank > slack").select("sign", "node").distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, math.ceil(chars / 8 / BUCKET_SIGNATURES))
    signed = docs.mapInArrow(bounded(_sign(buckets)), "bucket int, sets binary, signatures binary, doc_id long, set_id long, n int")
    # more partitions than buckets, so that few tasks hold several
    found = stage(signed.repartition(3 * buckets, "bucket").mapInArrow(bounded(_match, 16 << 20), _MATCH), "join-found")

    members = found.where(F.col("kind") == DOCUMENT).select("doc_id", "set_id", "n")
    groups = found.where(F.col("kind") == GROUP).select("set_id", "n", "members", "slacks")
    cliques = found.where(F.col("kind") == CLIQUE).groupBy(F.col("set_id").alias("name"))
    cliques = stage(cliques.agg(F.sum("shared").alias("shared"), *(F.first(c).alias(c) for c in ("members", "slacks", "sizes"))), "join-cliques")
    pairs = found.where(F.col("kind") == PAIR).groupBy(F.col("set_id").alias("a"), F.col("other").alias("b")).agg(F.sum("shared").alias("shared"), F.max("need").alias("need"))
    pairs, hot, per_set = stage(pairs, "join-twos"), None, None
    if not groups.isEmpty():
        hot = stage(_needed_groups(groups), "join-hot")
        per_set = stage(groups.select(F.explode("members").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("hot")), "join-hot-sets")
        if per_set.count() <= MAX_BROADCAST:
            per_set = F.broadcast(per_set)

    first = _best(_spokes(cliques), per_set).union(_best(pairs, per_set))
    ends = None
    if hot is not None:
        # a pivot a hot group, and for each set the pivot it meets most often: the rest of the groups is compared later
        pivot = stage(hot.groupBy("sign").agg(F.min("node").alias("a")), "join-pivot")
        met = hot.join(pivot, "sign").where("a <> node").groupBy(F.col("node").alias("b"), "a").agg(F.count(F.lit(1)).alias("times"))
        first = first.union(met.groupBy("b").agg(F.max(F.struct("times", "a")).alias("best")).select(F.col("best.a").alias("a"), "b"))
        ends = hot.select(F.col("node").alias("set_id"))
    first = stage(first.distinct(), "join-pairs")
    ends = _ends(first) if ends is None else _ends(first).union(ends)
    sets = _with_sets(docs, _wanted(ends, members), words)
    roots = components(_verified(first, sets))
    if hot is not None:
        # before any group gives pairs: a family of copies that no star joins is found here, without a row for a pair
        roots = _merged(roots, stage(_hot_links(hot, roots, sets), "join-links"))

    rest = _likely(_apart(pairs, cliques, roots), per_set).select("a", "b")
    rest = stage(rest.join(first, ["a", "b"], "left_anti"), "join-rest")
    if not rest.isEmpty():
        ends = stage(_ends(rest).distinct(), "join-rest-sets")
        new = _wanted(ends.join(sets.select("set_id"), "set_id", "left_anti"), members)
        late = sets.join(small(ends, MAX_BROADCAST), "set_id", "left_semi")
        if not new.isEmpty():
            late = late.union(_with_sets(docs, new, words))
        roots = _merged(roots, _verified(rest, late))
    return _labelled(members, roots)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set_id")).union(pairs.select("b"))


def _wanted(ends: DataFrame, members: DataFrame) -> DataFrame:
    """(set_id, doc_id): a document of each of the sets."""
    return stage(ends.distinct().join(members, "set_id").groupBy("set_id").agg(F.min("doc_id").alias("doc_id")), "join-wanted")


def _likely(pairs: DataFrame, per_set: DataFrame | None) -> DataFrame:
    """The pairs (a, b, shared, need) that share what a link needs, but for the hot signatures (node, hot) that they may share besides."""
    if per_set is not None:
        for side in ("a", "b"):
            pairs = pairs.join(per_set.select(F.col("node").alias(side), F.col("hot").alias(f"hot_{side}")), side, "left")
        pairs = pairs.withColumn("need", F.col("need") - F.greatest(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0))))
    return pairs.where("shared >= need")


def _best(pairs: DataFrame, per_set: DataFrame | None) -> DataFrame:
    """For each set the pair (a, b) that shares most, if it is likely: a row a set, however many pairs it is in."""
    best = pairs.groupBy("b").agg(F.max(F.struct("shared", "a", "need")).alias("best"))
    return _likely(best.select("best.a", "b", "best.shared", "best.need"), per_set).select("a", "b")


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components; the roots of up to ``MAX_BROADCAST`` sets go to every task, so no pair is joined to be dropped."""
    if roots.count() > MAX_BROADCAST:
        ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        return pairs.join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "shared", "need")
    table = roots.select("node", "root").toArrow().sort_by("node")
    known = pairs.sparkSession.sparkContext.broadcast((table.column("node").to_numpy(), table.column("root").to_numpy()))

    def run(batches):
        nodes, tops = known.value
        for batch in batches:
            ends = []
            for c in (0, 1):
                x = batch.column(c).to_numpy()
                at = np.minimum(np.searchsorted(nodes, x), max(0, len(nodes) - 1))
                ends.append(np.where(nodes[at] == x, tops[at], x) if len(nodes) else x)
            yield batch.filter(pa.array(ends[0] != ends[1]))

    each = pairs.select("a", "b", "shared", "need")
    return each.mapInArrow(run, each.schema)


def _fits(x: str, y: str) -> Column:
    """Whether the sizes of two members allow a link."""
    return 4 * F.least(f"{x}.sizes", f"{y}.sizes") >= 3 * F.greatest(f"{x}.sizes", f"{y}.sizes")


def _met(each: DataFrame) -> DataFrame:
    """(a, b, shared, need) from pairs of members (x, y) and how many signatures each pair shares."""
    differ = F.floor((F.col("x.sizes") + F.col("y.sizes")) / 7)
    need = F.when((F.col("x.slacks") > 0) & (F.col("y.slacks") > 0), F.greatest(F.lit(1), F.greatest("x.slacks", "y.slacks") - differ)).otherwise(1)
    return each.select(F.col("x.members").alias("a"), F.col("y.members").alias("b"), "shared", need.alias("need")).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"))


def _spokes(cliques: DataFrame) -> DataFrame:
    """The pairs of each group's smallest set with its others."""
    zipped = F.arrays_zip("members", "slacks", "sizes")
    each = cliques.select("shared", zipped[0].alias("x"), F.explode(F.slice(zipped, 2, HOT)).alias("y"))
    return _met(each.where(_fits("x", "y")))


def _apart(pairs: DataFrame, cliques: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs, those of groups included, whose ends are in different components."""
    two = _between(pairs, roots)
    root = F.coalesce("root", "node")
    met = cliques.select("name", F.explode("members").alias("node")).join(roots, "node", "left").groupBy("name").agg(F.min(root).alias("low"), F.max(root).alias("high"))
    split = stage(cliques.join(met.where("low <> high").select("name"), "name", "left_semi"), "join-split")
    each = split.select("name", "shared", F.explode(F.arrays_zip("members", "slacks", "sizes")).alias("x")).withColumn("node", F.col("x.members")).join(roots, "node", "left")
    placed = each.groupBy("name", "shared").agg(F.collect_list(F.struct("x.*", root.alias("root"))).alias("all"))
    drawn = placed.select("shared", "all", F.explode("all").alias("x"))
    drawn = drawn.select("shared", "x", F.explode(F.filter("all", lambda y: (y["members"] > F.col("x.members")) & (y["root"] != F.col("x.root")))).alias("y"))
    return two.unionByName(_met(drawn.where(_fits("x", "y")))).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further links, which are drawn between components only."""
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    between = links.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct()
    more = components(between)
    moved = roots.join(more.select(F.col("node").alias("old"), F.col("root").alias("new")), F.col("root") == F.col("old"), "left")
    return stage(moved.select("node", F.coalesce("new", "root").alias("root")).union(more), "join-roots")


def _compare_blocks(table: pa.Table) -> pa.Table:
    """A spanning forest of the links of a block's outsiders to members of other components."""
    root: dict[int, int] = {}
    kinds, nodes, own = (table.column(c).to_pylist() for c in ("outside", "node", "root"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("elements").to_pylist()]
    inside = [k for k, outside in enumerate(kinds) if not outside]
    size = np.array([len(sets[k]) for k in inside], np.int64)
    elements = np.concatenate([sets[k] for k in inside]) if inside else np.zeros(0, np.uint64)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], np.repeat(np.arange(len(inside)), size)[order]
    left, right = [], []
    for k in (k for k, outside in enumerate(kinds) if outside):
        low, high = np.searchsorted(elements, sets[k]), np.searchsorted(elements, sets[k], "right")
        count = high - low
        places = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        both = np.bincount(owner[places], minlength=len(inside))
        for j in np.flatnonzero(100 * both >= 75 * (len(sets[k]) + size - both)).tolist():
            if _join_roots(root, own[k], own[inside[j]]):
                left.append(nodes[k])
                right.append(nodes[inside[j]])
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _hot_links(hot: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """All links that are missing between components that meet in a hot group.

    In each group the sets outside its largest component are the outsiders.  They
    are compared, through an inverted index, with every member of the groups that
    have the same largest component: in blocks of outsiders against blocks of
    members, so a task holds a bounded number of sets and no pair is a row.
    """
    placed = hot.join(roots, "node", "left").select("sign", "node", F.coalesce("root", "node").alias("root"))
    sizes = placed.groupBy("sign", "root").agg(F.count(F.lit(1)).alias("size"))
    best = sizes.groupBy("sign").agg(F.max(F.struct("size", "root")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sign", F.col("best.root").alias("bundle"))
    members = stage(placed.join(best, "sign").select("bundle", "node", "root").distinct(), "join-bundles")
    outside = members.where("root <> bundle")
    width = sets.select("set_id", (F.octet_length("elements") / 8).alias("n"))
    blocks = (
        members.join(width, F.col("node") == F.col("set_id"))
        .groupBy("bundle")
        .agg(F.ceil(F.sum(F.when(F.col("root") != F.col("bundle"), 1).otherwise(0)) / OUTSIDERS).cast("int").alias("ys"), F.ceil(F.sum("n") / MEMBER_ELEMENTS).cast("int").alias("xs"))
    )
    blocks = stage(blocks.where("ys > 0 and xs > 0"), "join-blocks")
    # the sets of all other groups stay where they are
    sets = sets.join(small(stage(members.join(blocks, "bundle").select(F.col("node").alias("set_id")).distinct(), "join-compared"), MAX_BROADCAST), "set_id", "left_semi")
    spread = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = members.join(blocks, "bundle").select("bundle", "node", "root", F.lit(False).alias("outside"), spread("xs").alias("x"), every("ys").alias("y"))
    rows = rows.unionByName(outside.join(blocks, "bundle").select("bundle", "node", "root", F.lit(True).alias("outside"), spread("ys").alias("y"), every("xs").alias("x")))
    full = rows.join(sets.select(F.col("set_id").alias("node"), "elements"), "node")
    return full.groupBy("bundle", "x", "y").applyInArrow(_compare_blocks, "a long, b long").distinct()


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    keyed = members.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select("doc_id", "n", F.coalesce("root", "set_id").alias("root"))
    keyed = stage(keyed, "join-keyed")
    smallest = stage(keyed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "join-smallest")
    out = keyed.join(smallest, "root", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, exactly one row of each component: that with the smallest id, a null id after all others.

    Verdicts name the id and the text, so ids may be null or repeated; rows without
    words link with nothing and all stay.
    """
    (key,) = fresh(docs, "row_key")
    marked = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
    found = join(marked, key, text_col).where("n_shingles > 0").groupBy("component_id", F.col("doc_id").alias("key")).agg(F.count(F.lit(1)).alias("times"))
    ids = marked.groupBy(F.col(key).alias("key")).agg(F.min(id_col).alias("id"))
    members = stage(found.join(ids, "key"), "join-members")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key"))
    groups = members.groupBy("component_id").agg(first.alias("first"), F.sum("times").alias("size")).where("size > 1")
    groups = small(stage(groups.select("component_id", F.col("first.key").alias("first_key")), "join-groups"))
    judged = stage(members.join(groups, "component_id").select("key", "times", (F.col("key") == F.col("first_key")).alias("kept")), "join-judged")
    (gone,) = fresh(marked, "gone")
    # a kept row that is repeated goes as well, and one of its copies returns
    lost = small(stage(judged.where("not kept or times > 1").select(F.col("key").alias(gone)), "join-dropped"))
    kept = marked.join(lost, marked[key] == lost[gone], "left_anti")
    again = stage(judged.where("kept and times > 1").select(F.col("key").alias(gone)), "join-repeated")
    if not again.isEmpty():
        again = small(again)
        kept = kept.unionByName(marked.join(again, marked[key] == again[gone], "left_semi").dropDuplicates([key]))
    return kept.drop(key)
