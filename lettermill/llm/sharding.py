"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has ``2 ** CELL_BITS`` cells.  A row falls in the cell of its id's hash;
a cell belongs to the first virtual node clockwise.  Every shard has a capacity,
and what a full shard cannot take continues clockwise to the next shard with
room.  The capacities add up to the number of rows, so the law is ``rows``:
counts differ by one at most.

Only the row count of each cell goes to the driver: at most 16 384 numbers,
whatever the input.  There the walk round the ring turns counts into segments
(cell, ranks from-to, shard, first slot), one per cell and one more for each
shard that fills up.  Rows are ranked inside their cell and meet the segments in
a broadcast join whose size the ring bounds, so texts never shuffle and no task
sees more than a few cells.

Defined cases: a null text has no bytes (size 1) and the CRC of the empty text;
null ids share one cell and are ordered by size and CRC; repeated rows get slots
of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL_BITS = 14
VIRTUAL_NODES = 128
_SEGMENTS = "cell int, rank_from long, rank_to long, shard int, slot_from long, home_shard int"


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    return sorted((xxhash.xxh64_intdigest(f"shard {s} node {v}") >> (64 - CELL_BITS), s) for s in range(shards) for v in range(virtual_nodes))


def segments(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int, int, int]]:
    """Where the rows of each cell go, by rank in the cell."""
    nodes = ring(shards, virtual_nodes)
    cells = [c for c, _ in nodes]
    whole, more = divmod(sum(counts.values()), shards)
    room = [whole + (s < more) for s in range(shards)]
    filled = [0] * shards
    out = []
    for cell in sorted(counts):
        left, rank, at = counts[cell], 0, bisect.bisect_left(cells, cell)
        home = nodes[at % len(nodes)][1]
        while left:
            shard = nodes[at % len(nodes)][1]
            if take := min(left, room[shard]):
                out.append((cell, rank, rank + take, shard, filled[shard], home))
                room[shard] -= take
                filled[shard] += take
                rank, left = rank + take, left - take
            at += 1
    return out


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard of every row."""
    spark = docs.sparkSession
    # of the id and the text: rows that share an id, or have none, spread over the ring as well
    place = F.xxhash64(F.col(id_col), F.col(text_col))
    cell = F.shiftrightunsigned(place, 64 - CELL_BITS).cast("int")
    counts = {r["cell"]: r["n"] for r in docs.select(cell.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = F.broadcast(spark.createDataFrame(segments(counts, shards), _SEGMENTS))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place.alias("place"), cell.alias("cell")
    )
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("place", "doc_id", "size", "text_crc32")) - 1)
    return (
        ranked.join(where, "cell")
        .where("rank >= rank_from and rank < rank_to")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("slot_from") + F.col("rank") - F.col("rank_from")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "home_shard",
        )
    )
