"""Visibility of messages that remote sources map, and their effective folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state(sources: DataFrame) -> DataFrame:
    """uid, active, preexisting: one row for each mapped message."""
    return sources.groupBy("uid").agg(F.bool_or(~F.col("tombstoned")).alias("active"), F.bool_or("preexisting").alias("preexisting"))


def visible(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """Messages that are unmapped, or have a live source, or were there before any source."""
    joined = messages.join(state(sources), "uid", "left")
    return joined.where(F.coalesce(F.col("active") | F.col("preexisting"), F.lit(True))).select(*messages.columns)


def folder_memberships(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct (uid, folder): folders of live sources, and the own folder of messages that are unmapped or preexisting."""
    live = sources.where(~F.col("tombstoned")).select("uid", "folder")
    own = messages.join(state(sources).select("uid", "preexisting"), "uid", "left").where(F.coalesce("preexisting", F.lit(True))).select("uid", "folder")
    return live.union(own).where(F.col("folder") != "").distinct()


def effective_folders(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """uid, folders: the sorted folder names of each message that has any."""
    return folder_memberships(messages, sources).groupBy("uid").agg(F.array_sort(F.collect_list("folder")).alias("folders"))
