"""Evidence items: new rows, numbers, verification against surfaces, custody events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quotes import match_state
from .staging import stage


def new_items(rows: DataFrame) -> DataFrame:
    """Relevance between 1 and 5, categories of at most 80 characters, and the content hash of uid, category and quote."""
    return rows.withColumn("relevance", F.least(F.lit(5), F.greatest(F.lit(1), F.col("relevance")))).withColumn("category", F.substring("category", 1, 80)).withColumn("content_hash", F.sha2(F.concat_ws("|", "email_uid", "category", "key_quote"), 256))


def numbered(rows: DataFrame, prefix: str, order: list[str], blocks: int = 64) -> DataFrame:
    """``E-1``, ``E-2``, ... in order: ranges are numbered apart and shifted by the sizes before them, so no task sees all rows.

    The ranges are staged with their numbers: a lost executor cannot move their bounds.
    """
    placed = stage(rows.repartitionByRange(blocks, *order).withColumn("part", F.spark_partition_id()), "evidence-ranges")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "start")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("start")
    return placed.join(F.broadcast(starts), "part").select(*rows.columns, F.concat(F.lit(f"{prefix}-"), place.cast("string")).alias("label"))


def verify(items: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(items..., state): the best match of each quote over its message's surfaces; orphaned without any."""
    joined = items.join(surfaces.select(F.col("uid").alias("email_uid"), F.col("text").alias("surface")), "email_uid", "left")
    rank = F.when(F.col("state") == "exact", 0).when(F.col("state") == "near_exact", 1).when(F.col("state") == "unverified", 2).otherwise(3)
    scored = joined.withColumn("state", match_state(F.col("key_quote"), F.col("surface"))).withColumn("rank", rank)
    return scored.groupBy(*items.columns).agg(F.min_by("state", "rank").alias("state"))


def custody(events: DataFrame, target: str | None = None) -> DataFrame:
    """The append-only log of a target, newest first."""
    rows = events if target is None else events.where(F.col("target_id") == target)
    return rows.orderBy(F.desc("at"), "event_id")


def categories(items: DataFrame, suggested: DataFrame) -> DataFrame:
    """Suggested categories in their order with counts, then all others by name."""
    counts = items.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    names = suggested.select(F.col("category").alias("name"), "place")
    both = F.broadcast(names).join(counts, F.col("name") == F.col("category"), "full")
    return both.select(F.coalesce("name", "category").alias("category"), F.coalesce("n", F.lit(0)).alias("n"), "place").orderBy(F.col("place").asc_nulls_last(), "category")
