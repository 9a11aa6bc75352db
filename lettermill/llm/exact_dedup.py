"""Exact deduplication by two passes over a Bloom filter.

Texts are equal when identical after deleting ASCII white space.  One scan turns
the documents into a narrow table (id, length, SHA-256 of the normalised text).

Pass 1 builds a counting Bloom filter: every hash owns two cells of one 4 KB
block, cells are counted with map-side aggregation, and the cells hit at least
twice are packed into bitmaps.  Pass 2 tests each row against its block: a hash
that occurs twice has both its bits set, so a row with a clear bit is certainly
unique and passes straight through.  Only the others shuffle by hash and are
grouped exactly, so false positives cost work but never change the result.

The filter takes ``bits_per_row`` bits a row.  It is broadcast while that is
under ``max_broadcast_bytes``; beyond it the rows are joined to their block by a
shuffle.  A hot group collapses in the map-side aggregates; the join that brings
the kept row back has a plain exchange on both sides, which AQE splits.

Defined cases: null texts count as empty; empty texts equal each other; of tied
lengths the smallest id stays, a null id after all others; of fully repeated
rows exactly one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, small, stage

BLOCK_BITS = 32768


def text_hash(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text without ASCII white space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+", ""), 256)


def _cells(sha: Column, blocks: int) -> list[Column]:
    """Block number and two different bit positions of a hash."""
    first = F.pmod(F.xxhash64(sha, F.lit(1)), F.lit(BLOCK_BITS))
    step = F.pmod(F.xxhash64(sha, F.lit(2)), F.lit(BLOCK_BITS - 1)) + 1
    return [
        F.pmod(F.xxhash64(sha), F.lit(blocks)).cast("int").alias("block"),
        first.cast("int").alias("bit1"),
        ((first + step) % BLOCK_BITS).cast("int").alias("bit2"),
    ]


def _repeated_bits(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the cells that at least two rows hit."""
    cells = rows.select(*_cells(F.col("text_sha256"), blocks)).select("block", F.explode(F.array("bit1", "bit2")).alias("bit"))
    twice = cells.groupBy("block", "bit").agg(F.count(F.lit(1)).alias("hits")).where("hits > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits"))


def _is_set(bits: str, bit: str) -> Column:
    return F.expr(f"(shiftright(cast(conv(hex(substring({bits}, {bit} div 8 + 1, 1)), 16, 10) as int), {bit} % 8) & 1) = 1")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_broadcast_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars."""
    rows = stage(
        docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars"), text_hash(F.col(text_col)).alias("text_sha256")),
        "dedup-rows",
    )
    blocks = max(1, math.ceil(rows.count() * bits_per_row / BLOCK_BITS))
    bits = stage(_repeated_bits(rows, blocks), "dedup-bits")
    if blocks * BLOCK_BITS // 8 <= max_broadcast_bytes:
        bits = F.broadcast(bits)
    tested = rows.select("*", *_cells(F.col("text_sha256"), blocks)).join(bits, "block", "left")
    tested = tested.withColumn("maybe", F.coalesce(_is_set("bits", "bit1") & _is_set("bits", "bit2"), F.lit(False)))
    tested = tested.select("doc_id", "n_chars", "text_sha256", "maybe")
    alone = tested.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "n_chars"
    )

    again = stage(tested.where("maybe").groupBy("text_sha256", "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("times")), "dedup-maybe")
    order = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"))
    best = stage(again.groupBy("text_sha256").agg(F.min(order).alias("best"), F.sum("times").alias("group_size")), "dedup-best")
    grouped = (
        again.join(best, "text_sha256")
        .select("*", F.explode(F.expr("sequence(1, cast(times as int))")).alias("copy"))
        .select(
            "doc_id",
            F.col("best.keep_id").alias("keep_id"),
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("best.keep_id")) & (F.col("n_chars") == -F.col("best.shorter")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
            "n_chars",
        )
    )
    return alone.unionByName(grouped)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all its columns, less the rows that :func:`decide` drops.

    Only the ids of dropped rows are joined back, so the texts of unique rows do
    not shuffle when that list is small enough to be broadcast by size.
    """
    verdict = stage(decide(docs, id_col, text_col, **options).where("group_size > 1"), "dedup-verdict")
    sha, gone = fresh(docs, "sha_of_text", "gone")
    key = [id_col, sha]
    marked = docs.withColumn(sha, text_hash(F.col(text_col)))
    lost = verdict.where("not kept").select(F.col("doc_id").alias(f"{gone}_id"), F.col("text_sha256").alias(f"{gone}_sha")).distinct()
    lost = stage(lost, "dedup-lost")
    match = lambda d: F.col(id_col).eqNullSafe(d[f"{gone}_id"]) & (F.col(sha) == d[f"{gone}_sha"])
    lost_ = small(lost)
    kept = marked.join(lost_, match(lost_), "left_anti")
    # a kept document whose id and text also occur in a dropped row: one of them returns
    both = verdict.where("kept").select(F.col("doc_id").alias(f"{gone}_id"), F.col("text_sha256").alias(f"{gone}_sha"), (F.col("n_chars")).alias(f"{gone}_n"))
    both = both.join(lost.withColumnRenamed(f"{gone}_id", "l_id").withColumnRenamed(f"{gone}_sha", "l_sha"), F.col(f"{gone}_id").eqNullSafe(F.col("l_id")) & (F.col(f"{gone}_sha") == F.col("l_sha")), "left_semi")
    both = small(stage(both, "dedup-both"))
    back = marked.join(both, match(both) & (F.length(F.coalesce(F.col(text_col), F.lit(""))) == both[f"{gone}_n"])).select(*marked.columns).dropDuplicates(key)
    return kept.unionByName(back).drop(sha)
