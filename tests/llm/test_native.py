"""Exact dedup, sharding and the secret scan against plain Python."""

import bisect
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from lettermill.llm import exact_dedup, secret_scan, sharding

from .fixtures import empty, frame

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def plain_rows(df):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in df.collect()]


@pytest.fixture(scope="module", params=["awkward", "sf"])
def docs(request, spark, sf_dir):
    return frame(spark) if request.param == "awkward" else spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_dedup_matches_brute_force(spark, docs):
    groups = defaultdict(list)
    for i, text, _ in plain_rows(docs):
        groups[hashlib.sha256(WHITE.sub("", text).encode()).hexdigest()].append((-len(text), i is None, i))
    expected = Counter()
    for sha, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for k, m in enumerate(members):
            expected[(m[2], members[0][2], len(members), k == 0, sha)] += 1
    for limit in (32 << 20, 0):
        got = exact_dedup.decide(docs, max_broadcast_bytes=limit)
        assert Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got.collect()) == expected
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(k[0] for k, n in expected.items() if k[3] for _ in range(n))


def test_sharding_is_gapless_and_even(spark, docs):
    got = sharding.assign(docs).collect()
    rows = [(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in plain_rows(docs)]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)


def test_segments_walk_clockwise():
    counts = {c: 3 for c in range(0, 16384, 5)}
    placed = sharding.segments(counts, 16)
    assert sum(b - a for _, a, b, *_ in placed) == sum(counts.values())
    moved = sum(b - a for _, a, b, shard, _, home in placed if shard != home)
    assert moved < 0.25 * sum(counts.values())  # limited movement from the plain ring
    spots = defaultdict(list)
    for _, a, b, shard, slot, _ in placed:
        spots[shard] += range(slot, slot + b - a)
    assert all(sorted(v) == list(range(len(v))) for v in spots.values())


def base_spans(text):
    patterns = [
        (r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "assign"),
        (r"AKIA[A-Z0-9]+", 0, 16, "access"),
        (r"[0-9a-f]+", 0, 32, "hex"),
    ]
    found = []
    for rank, (pattern, group, least, kind) in enumerate(patterns):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found)


def test_secret_base_spans(spark, docs):
    got = Counter()
    for r in secret_scan.scan(docs).collect():
        got[(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"])] += 1
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert kinds.count("assign") == r["n_assign"] and kinds.count("hex") == r["n_hex"]
    expected = Counter()
    for i, text, _ in plain_rows(docs):
        spans = base_spans(text)
        n = Counter(s[2] for s in spans)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()
        expected[(i, n["assign"], n["access"], n["hex"], digest)] += 1
    assert got == expected


def test_copied_values_are_told_from_owned_ones(spark):
    example, owned = "AbCdEf0123456789AbCdEf012345", "ZyXwVu9876543210ZyXwVu987654"
    rows = [(i, f"use {example} here", f"repo{i}") for i in range(8)] + [(20, f"use {owned} here", "repo1"), (21, f"again {owned}", "repo1")]
    got = {r["doc_id"]: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["spans"] == "" and got[i]["n_copied"] == 1 for i in range(8))
    assert got[20]["spans"] == f"opaque:4:{4 + len(owned)}" and got[21]["n_live"] == 1


def test_empty_tables(spark):
    for out in (exact_dedup.decide(empty(spark)), exact_dedup.deduplicate(empty(spark)), sharding.assign(empty(spark)), secret_scan.scan(empty(spark))):
        assert out.count() == 0


def test_ring_places_every_row_as_one_by_one(spark):
    """Rows taken cell by cell, each put into the first shard clockwise that has room."""
    rows = [(k if k % 3 else None, f"text {k % 50}" * (k % 7)) for k in range(400)] + [(5, "same")] * 90
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(docs, 5).collect()
    order = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("place")).collect()
    nodes = sorted((xxhash.xxh64_intdigest(f"shard {s} node {v}") >> 50, s) for s in range(5) for v in range(128))
    room, slots, want = [98] * 5, [0] * 5, Counter()
    key = lambda r: ((r["place"] % 2**64) >> 50, r["place"], r["doc_id"] is not None, r["doc_id"] or 0, len(r["text"].encode()) + 1, zlib.crc32(r["text"].encode()))
    for r in sorted(order, key=key):
        start = bisect.bisect_left(nodes, (key(r)[0], -1))
        at = start
        while not room[nodes[at % len(nodes)][1]]:
            at += 1
        shard = nodes[at % len(nodes)][1]
        want[r["doc_id"], r["text"], shard, slots[shard], nodes[start % len(nodes)][1]] += 1
        room[shard] -= 1
        slots[shard] += 1
    texts = {(len(t.encode()) + 1, zlib.crc32(t.encode())): t for _, t in rows}
    assert Counter((r["doc_id"], texts[r["size"], r["text_crc32"]], r["shard"], r["slot"], r["home_shard"]) for r in got) == want
    assert sorted(Counter(r["shard"] for r in got).values()) == [98] * 5
