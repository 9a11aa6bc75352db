"""Thread linking by reply headers, and what happens along a thread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import stage


def message_key(column):
    """A message id without its angle brackets."""
    return F.regexp_replace(F.trim(column), "^<|>$", "")


def thread_roots(messages: DataFrame) -> DataFrame:
    """(uid, thread_id): the root of each message's reply chain, by pointer jumping.

    A parent that is not in the archive makes its child a root.  Rounds double the
    distance covered, so chains of n messages need log2(n) equi-joins; a cycle is
    cut at its smallest uid.
    """
    ids = messages.select(F.col("uid").alias("parent_uid"))
    links = messages.select("uid", message_key(F.col("in_reply_to")).alias("up")).join(ids, F.col("up") == F.col("parent_uid"), "left")
    links = stage(links.select("uid", F.coalesce("parent_uid", "uid").alias("up"), F.least("uid", F.coalesce("parent_uid", "uid")).alias("low"), (F.col("parent_uid").isNull() | (F.col("parent_uid") == F.col("uid"))).alias("is_root")), "thread-links")
    roots = links.where("is_root").select(F.col("uid").alias("root"))
    for _ in range(max(1, links.count()).bit_length() + 1):
        above = links.select(F.col("uid").alias("u"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        jumped = stage(links.join(above, F.col("up") == F.col("u")).select("uid", F.col("up2").alias("next"), F.least("low", "low2").alias("low"), (F.col("up2") != F.col("up")).alias("moved")), "thread-jump")
        moved = not jumped.where("moved").isEmpty()
        links = jumped.select("uid", F.col("next").alias("up"), "low")
        if not moved:
            break
    # what ends at no root is in a cycle, or leads into one: the cycle's smallest uid stands for it
    ends = links.select(F.col("uid").alias("end"), F.col("low").alias("end_low"))
    placed = links.join(ends, F.col("up") == F.col("end")).join(roots, F.col("up") == F.col("root"), "left")
    return placed.select("uid", F.coalesce("root", "end_low").alias("thread_id"))


def transitions(messages: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """Whether ``column`` differs from the last value before it that was not empty."""
    window = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.nullif(F.col(column), F.lit("")), ignorenulls=True).over(window)
    return messages.withColumn("previous", before).withColumn("changed", F.col("previous").isNotNull() & (F.col(column) != F.col("previous")))


def summaries(turns: DataFrame) -> DataFrame:
    """Per thread: messages, participants, first and last sender, characters."""
    return turns.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("messages"), F.array_join(F.array_sort(F.collect_set("sender")), ",").alias("participants"), F.min_by("sender", "turn").alias("first_sender"),
        F.max_by("sender", "turn").alias("last_sender"), F.sum(F.length("body")).alias("chars"),
    )
