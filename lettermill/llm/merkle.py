"""Merkle manifest of a dataset: every row has a proof against one root.

A leaf is the SHA-256 of a row's columns.  Leaves of a language, ascending by id,
are hashed eight at a time until one node, the language's subroot, remains; the
subroots, ordered by language, are hashed to the root in the same way.

Rows get their place by one range sort of the narrow leaf table and the counts of
its partitions, so a language that holds most rows is spread like any other.  A
place decides its aligned block of 8^3 leaves.  Each block is one contiguous
matrix of digests, 64 hex bytes a row: reshaped to 512 bytes a row it is what the
next level hashes.  Only block digests go up, again in blocks, until a language has
one node; on the way down every block gets the runs above it, and the siblings of
all its rows follow from index arithmetic on the same matrices.  Nothing larger
than a block is in one task at once, and languages are numbered by the same sort.

Defined cases: a null column counts as ``-``, so a null language is a language of its own,
before all others; a null id sorts first; rows that share language and id are
ordered by leaf, and equal rows take neighbouring places; the last run of a level
is short; a lone leaf is its own subroot and a lone subroot the root; an empty
table gives an empty result; columns beside the named ones are no part of a leaf.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, small, small_batches, stage

FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves in a partition of the range sort.
PARTITION_ROWS = 50_000
HEX = 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf(columns: list[Column]) -> Column:
    """SHA-256 of the columns, each as byte count, colon and value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tampered(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 0, F.lit(False))


# Digest matrices


def hash_rows(runs: list[bytes]) -> bytes:
    return b"".join(hashlib.sha256(r).hexdigest().encode() for r in runs)


def next_level(matrix: np.ndarray) -> np.ndarray:
    """The nodes above a contiguous (n, 64) matrix: one for every run of ``FANOUT`` rows."""
    flat, width = matrix.tobytes(), FANOUT * HEX
    return np.frombuffer(hash_rows([flat[k : k + width] for k in range(0, len(flat), width)]), np.uint8).reshape(-1, HEX)


def depth(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def climb(matrix: np.ndarray, total: int) -> list[np.ndarray]:
    """All levels of a block, its own first; ``total`` is the number of nodes on its level in the whole group."""
    levels = [matrix]
    for _ in range(min(LEVELS, depth(total))):
        levels.append(next_level(levels[-1]))
    return levels


def runs_above(levels: list[np.ndarray], at: int) -> list[tuple[bytes, int]]:
    """For row ``at`` of a block, level by level: the run that holds its node, and the node's place in it."""
    out = []
    for nodes in levels[:-1]:
        low = at - at % FANOUT
        out.append((nodes[low : low + FANOUT].tobytes(), at - low))
        at //= FANOUT
    return out


def siblings(path: list[tuple[bytes, int]]) -> bytes:
    return b"".join(run[: at * HEX] + run[(at + 1) * HEX :] for run, at in path)


def fold(digest: bytes, path: list[tuple[bytes, int]]) -> bytes:
    """The digest at the end of the path when ``digest`` is at its beginning."""
    for run, at in path:
        digest = hashlib.sha256(run[: at * HEX] + digest + run[(at + 1) * HEX :]).hexdigest().encode()
    return digest


def _pack(path: list[tuple[bytes, int]]) -> list[dict]:
    return [{"run": run, "at": at} for run, at in path]


def _unpack(path) -> list[tuple[bytes, int]]:
    return [(bytes(x["run"]), int(x["at"])) for x in path or []]


# Places and blocks

_PATH = "array<struct<run:binary,at:int>>"
_BLOCK = "grp string, block long, total long, ids array<string>, digests binary, changed binary, top string"


def places(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``grp``) plus ``place`` in the group by ``order`` and ``total`` of the group."""
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // PARTITION_ROWS))
    tie = "tie_"
    sorted_ = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, "grp", *order, tie).sortWithinPartitions("grp", *order, tie).drop(tie)
    sorted_ = sorted_.withColumn("part", F.spark_partition_id())
    small_batches(spark, 8192)

    def number(batches):
        last, seen = None, 0
        for batch in batches:
            groups = batch.column("grp")
            codes = groups.dictionary_encode()
            code, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            begins = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
            index = np.arange(len(code)) - np.repeat(begins, np.diff(np.r_[begins, len(code)]))
            if len(code):
                if names[code[0]] == last:
                    head = int(begins[1]) if len(begins) > 1 else len(code)
                    index[:head] += seen
                last, seen = names[code[-1]], int(index[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index, pa.int64())], names=[*batch.schema.names, "index"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted_.schema) + ", index long"
    numbered = stage(sorted_.mapInArrow(number, schema), "merkle-places")
    counts = numbered.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(counts.select("grp", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("low"), F.sum("n").over(Window.partitionBy("grp")).alias("total")), "merkle-offsets")
    return numbered.join(small(offsets), ["grp", "part"]).withColumn("place", F.col("low") + F.col("index")).drop("part", "low", "index")


def blocks(nodes: DataFrame) -> DataFrame:
    """One row per aligned block of nodes (grp, place, total, id, digest, changed): its matrices and the digest on top."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place", kind="stable")
        total = int(frame["total"].iloc[0])
        flat = "".join(frame["digest"]).encode()
        top = climb(np.frombuffer(flat, np.uint8).reshape(-1, HEX), total)[-1].tobytes().decode()
        changed = "".join(frame["changed"].fillna(" " * HEX)).encode()
        return pd.DataFrame({"grp": frame["grp"].iloc[:1].values, "block": frame["block"].iloc[:1].values, "total": [total], "ids": [frame["id"].tolist()], "digests": [flat], "changed": [changed], "top": [top]})

    cut = nodes.select("grp", F.expr(f"place div {BLOCK}").alias("block"), "place", "total", "id", "digest", "changed")
    return stage(cut.groupBy("grp", "block").applyInPandas(build, _BLOCK), "merkle-blocks")


def tree(nodes: DataFrame) -> list[DataFrame]:
    """The staged blocks of every round, leaves first, up to rounds with one block a group."""
    rounds = [blocks(nodes)]
    while True:
        open_ = rounds[-1].where(F.col("total") > BLOCK)
        if open_.isEmpty():
            return rounds
        above = open_.select("grp", F.col("block").alias("place"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), F.lit(None).cast("string").alias("id"), F.col("top").alias("digest"), F.lit(None).cast("string").alias("changed"))
        rounds.append(blocks(above))


def tops(rounds: list[DataFrame]) -> DataFrame:
    """(grp, digest): the one node that remains of each group."""
    done = [r.where(F.col("total") <= BLOCK).select("grp", F.col("top").alias("digest")) for r in rounds]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _children(batches):
    """Rows (grp, block, id, path) of all nodes of the blocks: what is above each of them."""
    for batch in batches:
        for row in batch.to_pylist():
            matrix = np.frombuffer(row["digests"], np.uint8).reshape(-1, HEX)
            levels, above = climb(matrix, row["total"]), _unpack(row["path"])
            out = [(row["grp"], row["block"] * BLOCK + k, i, _pack(runs_above(levels, k) + above)) for k, i in enumerate(row["ids"])]
            grp, place, id_, path = zip(*out, strict=True)
            kind = pa.list_(pa.struct([("run", pa.binary()), ("at", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(grp, pa.string()), pa.array(place, pa.int64()), pa.array(id_, pa.string()), pa.array(path, kind)], names=["grp", "block", "id", "path"])


def _with_path(round_: DataFrame, paths: DataFrame | None, top_paths: DataFrame | None) -> DataFrame:
    """Blocks with what is above them: inside their group from ``paths``, above the group from ``top_paths``."""
    none = F.lit(None).cast(_PATH)
    lone = round_.where(F.col("total") <= BLOCK)
    lone = lone.withColumn("path", none) if top_paths is None else lone.join(small(top_paths, 2_000), "grp", "left")
    if paths is None:
        return lone
    return lone.unionByName(round_.where(F.col("total") > BLOCK).join(paths.select("grp", "block", "path"), ["grp", "block"]))


def descend(rounds: list[DataFrame], top_paths: DataFrame | None) -> DataFrame:
    """The blocks of the first round with what is above each; ``top_paths`` (grp, path) is what is above a group."""
    paths = None
    for round_ in reversed(rounds[1:]):
        given = _with_path(round_, paths, top_paths).select("grp", "block", "total", "ids", "digests", "path")
        paths = stage(given.mapInArrow(bounded(_children), f"grp string, block long, id string, path {_PATH}"), "merkle-paths")
    return _with_path(rounds[0], paths, top_paths)


def _prove(batches):
    """One row per leaf of the blocks: its proof's digest and the root that it folds to."""
    for batch in batches:
        for row in batch.to_pylist():
            matrix = np.frombuffer(row["digests"], np.uint8).reshape(-1, HEX)
            levels, above = climb(matrix, row["total"]), _unpack(row["path"])
            outer, folded = siblings(above), {}
            proofs, roots, leaves = [], [], []
            for k in range(len(matrix)):
                inner = runs_above(levels, k)
                proofs.append(hashlib.sha256(siblings(inner) + outer).hexdigest())
                own = matrix[k].tobytes()
                changed = row["changed"][k * HEX : (k + 1) * HEX]
                top = fold(own if changed[:1] == b" " else changed, inner)
                if top not in folded:
                    folded[top] = fold(top, above).decode()
                roots.append(folded[top])
                leaves.append(own.decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.string()), pa.array([row["grp"]] * len(leaves), pa.string()), *(pa.array(x, pa.string()) for x in (leaves, proofs, roots))],
                names=["doc_id", "grp", "leaf", "proof_sha256", "folded_root"],
            )


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; ``columns`` are id, source, lang, count, text."""
    spark = docs.sparkSession
    id_, _, lang, _, text = (F.col(c) for c in columns)
    own = [F.col(c) for c in columns]
    changed = F.when(tampered(id_), leaf([*own[:-1], F.translate(text, _UPPER, _UPPER.lower())]))
    # null first, then by UTF-8 bytes
    group = F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), lang))
    leaves = stage(docs.select(id_.cast("long").alias("number"), group.alias("grp"), leaf(own).alias("digest"), changed.alias("changed")), "merkle-leaves")
    if leaves.isEmpty():
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    numbered = places(leaves, ["number", "digest"]).withColumn("id", F.col("number").cast("string"))
    rounds = tree(numbered)
    subroots = stage(tops(rounds), "merkle-subroots")
    by_lang = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), "digest", F.lit(None).cast("string").alias("changed"))
    upper = tree(places(by_lang, ["id"]))
    root = tops(upper).first()["digest"]
    small_batches(spark, 4)
    top = descend(upper, None).select("grp", "block", "total", "ids", "digests", "path")
    top_paths = stage(top.mapInArrow(bounded(_children), f"grp string, block long, id string, path {_PATH}").select(F.col("id").alias("grp"), "path"), "merkle-tops")
    proved = descend(rounds, top_paths).select("grp", "total", "ids", "digests", "changed", "path")
    proved = proved.mapInArrow(bounded(_prove), "doc_id string, grp string, leaf string, proof_sha256 string, folded_root string")
    proved = proved.join(small(subroots.select("grp", F.col("digest").alias("subroot"))), "grp")
    return proved.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
