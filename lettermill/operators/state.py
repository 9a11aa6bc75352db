"""Batch forms of the incremental operators: upserts, journals, tombstones, cursors, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert_if_absent(existing: DataFrame, arriving: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The arriving rows to append: keys not stored yet, the first of each key."""
    first = Window.partitionBy(key).orderBy(*order)
    new = arriving.join(existing.select(key), key, "left_anti")
    return new.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def merge_latest(stored: DataFrame, changes: DataFrame, key: str, sequence: str) -> DataFrame:
    """Stored rows overwritten by the change with the largest sequence; deletes remove them."""
    latest = compact(changes, key, sequence)
    kept = stored.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest.where("operation <> 'delete'").select(*stored.columns))


def compact(journal: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last change of every key: a map-side aggregate, so a busy key shuffles one row a task."""
    rest = [c for c in journal.columns if c != key]
    best = journal.groupBy(key).agg(F.max_by(F.struct(*rest), sequence).alias("last"))
    return best.select(key, *(F.col("last")[c].alias(c) for c in rest))


def tombstones(state: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """State rows that a full refresh did not see, marked as deleted."""
    return state.join(snapshot.select(*keys).distinct(), keys, "left_anti").withColumn("tombstoned", F.lit(True))


def advance(cursors: DataFrame, proposals: DataFrame) -> DataFrame:
    """Cursors moved by the proposals whose generation and expected value still hold.

    cursors: folder, generation, value; proposals: folder, generation, expected, value.
    """
    p = proposals.select("folder", F.col("generation").alias("p_generation"), "expected", F.col("value").alias("p_value"))
    p = p.groupBy("folder", "p_generation", "expected").agg(F.max("p_value").alias("p_value"))
    same = (cursors["generation"] == F.col("p_generation")) & (cursors["value"].eqNullSafe(F.col("expected")))
    joined = cursors.join(p.withColumnRenamed("folder", "p_folder"), (cursors["folder"] == F.col("p_folder")) & same, "left")
    return joined.select("folder", "generation", F.coalesce("p_value", "value").alias("value"), F.col("p_value").isNotNull().alias("advanced"))


def history(changes: DataFrame, key: str, sequence: str, columns: list[str]) -> DataFrame:
    """Versions of every key with the sequence range in which each holds; equal neighbours are one version."""
    order = Window.partitionBy(key).orderBy(sequence)
    version = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    marked = changes.withColumn("version", version).withColumn("fresh", ~F.col("version").eqNullSafe(F.lag("version").over(order)))
    starts = marked.where("fresh")
    return starts.select(key, *columns, F.col(sequence).alias("valid_from"), F.lead(sequence).over(order).alias("valid_to"))


def stale(rows: DataFrame, current: str, column: str) -> DataFrame:
    """Rows made by another model or rule version than the current one."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(current)))
