"""Search results: their filters, order, sessions and exports.

A result is a row with score, calibration and the metadata of its message.  All
filters are Columns, applied before any limit, so a filter never costs results.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filters import contains_like, flag, in_list, sender_matches


def result_filter(
    sender: str | None = None, subject: str | None = None, folder: str | None = None, cc: str | None = None, to: str | None = None, bcc: str | None = None, email_type: str | None = None,
    date_from: str | None = None, date_to: str | None = None, has_attachments: bool | None = None, priority: int | None = None, is_calendar: bool | None = None, category: str | None = None,
    attachment_name: str | None = None, attachment_type: str | None = None, min_score: float | None = None,
) -> Column:
    """The conjunction of what is given; rows without a date that starts with a digit fail date filters."""
    tests = [F.lit(True)]
    if sender:
        tests.append(sender_matches(F.col("sender_email"), F.col("sender_name"), sender))
    for column, needle in (("subject", subject), ("cc", cc), ("to", to), ("bcc", bcc)):
        if needle:
            tests.append(contains_like(F.col(column), needle))
    if folder:
        tests.append(F.exists(F.coalesce(F.when(F.size("source_folders") > 0, F.col("source_folders")), F.array("folder")), lambda f: contains_like(f, folder)))
    if email_type:
        tests.append(F.lower("email_type") == email_type.lower())
    day = F.substring(F.col("date").cast("string"), 1, 10)
    if date_from:
        tests.append(day.rlike("^[0-9]") & (day >= date_from[:10]))
    if date_to:
        tests.append(day.rlike("^[0-9]") & (day <= date_to[:10]))
    if has_attachments is not None:
        tests.append(flag(F.col("has_attachments")) == has_attachments)
    if priority is not None:
        tests.append(F.coalesce(F.expr("try_cast(priority as int)"), F.lit(0)) >= priority)
    if is_calendar is not None:
        tests.append(flag(F.col("is_calendar_message")) == is_calendar)
    if category:
        tests.append(in_list(F.col("categories"), category))
    names = F.transform(F.split(F.lower(F.coalesce("attachment_names", F.lit(""))), ","), lambda n: F.trim(n))
    if attachment_name:
        tests.append(contains_like(F.col("attachment_names"), attachment_name))
    if attachment_type:
        tests.append(F.exists(names, lambda n: n.endswith("." + attachment_type.lower().lstrip("."))))
    if min_score is not None:
        tests.append((F.col("calibration") == "synthetic") | (F.col("score") >= min_score))
    return reduce(Column.__and__, (F.coalesce(t, F.lit(False)) for t in tests))


def allowed(rows: DataFrame, *uid_sets: DataFrame) -> DataFrame:
    """Rows whose uid is in every given set."""
    return reduce(lambda r, s: r.join(s.select("uid"), "uid", "left_semi"), uid_sets, rows)


def best_per_message(rows: DataFrame) -> DataFrame:
    """One row a message, the best by score: by uid, else message id, else sender, day and subject; rows of no key all stay."""
    day = F.substring(F.col("date").cast("string"), 1, 10)
    fallback = F.when((F.col("sender_email") != "") & (F.col("subject") != ""), F.concat_ws("|", "sender_email", day, "subject"))
    key = F.coalesce(F.nullif(F.col("uid"), F.lit("")), F.nullif(F.col("message_id"), F.lit("")), fallback)
    keyed = rows.withColumn("dedup_key", key)
    order = Window.partitionBy("dedup_key").orderBy(F.desc("score"), "chunk_id")
    ranked = keyed.where("dedup_key is not null").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    return ranked.unionByName(keyed.where("dedup_key is null")).drop("dedup_key")


def sort_results(rows: DataFrame, by: str = "score") -> DataFrame:
    orders = {"date": [F.desc_nulls_last("date")], "sender": [F.asc_nulls_first("sender_email")], "score": [F.desc("score")]}
    return rows.orderBy(*orders.get(by, orders["score"]), "uid")


def unseen(rows: DataFrame, seen: DataFrame, now: Column, ttl_seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(rows not seen in a live session, the seen table with them added); a session expires after ``ttl_seconds``."""
    live = seen.where(F.unix_timestamp("seen_at") + ttl_seconds >= F.unix_timestamp(now))
    new = rows.join(live.select("uid"), "uid", "left_anti")
    return new, live.unionByName(new.select("uid", now.alias("seen_at")).distinct())


def conversation_groups(rows: DataFrame) -> DataFrame:
    """Per thread: best score and uid, matches, participants, first and last date."""
    return rows.groupBy("conversation_id").agg(
        F.max("score").alias("top_score"), F.max_by("uid", F.struct("score", "uid")).alias("top_uid"), F.count_distinct("uid").alias("matches"),
        F.array_join(F.array_sort(F.collect_set("sender_email")), ",").alias("participants"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


def triage(rows: DataFrame, preview: int = 200) -> DataFrame:
    """Compact entries: uid, sender, day, score to three places (the binary value is rounded, not its decimal print), preview."""
    return rows.select(
        "uid", F.col("sender_email").alias("sender"), F.substring(F.col("date").cast("string"), 1, 10).alias("day"), (F.round(F.col("score") * 1000) / 1000).alias("score"),
        F.when(F.length("text") > preview, F.concat(F.substring("text", 1, preview), F.lit("..."))).otherwise(F.col("text")).alias("preview"),
    )


def suggestions(tables: Iterable[tuple[str, DataFrame, str]], limit: int = 10) -> DataFrame:
    """(kind, value, n): the most frequent values of several columns, each a top-k of its own."""
    parts = [rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit).select(F.lit(kind).alias("kind"), "value", "n") for kind, rows, column in tables]
    return reduce(DataFrame.union, parts)


def infer_parents(children: DataFrame, parents: DataFrame, days: int = 30, accept: float = 0.8, margin: float = 0.15) -> DataFrame:
    """(uid, parent_uid, confidence): the parent that scores clearly best.

    Candidates share the base subject and are earlier by at most ``days``; they are
    found by an equi-join on subject and block of ``days`` days, each child looking at its own block and the one
    before, so that a busy subject is spread over its blocks.  Both sides have uid, base_subject, date,
    sender_email, participants (array), opening; children also reply_from and reply_subject.
    """
    block = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / (days * 86_400))
    child = children.withColumn("m", F.explode(F.array(block(F.col("date")), block(F.col("date")) - 1)))
    parent = parents.select(*(F.col(c).alias(f"p_{c}") for c in ("uid", "base_subject", "date", "sender_email", "participants", "opening"))).withColumn("p_m", block(F.col("p_date")))
    gap = (F.unix_seconds(F.col("date").cast("timestamp")) - F.unix_seconds(F.col("p_date").cast("timestamp"))) / 3600
    # which is earlier is told to the microsecond, so a parent may lie in the same second
    apart = F.unix_micros(F.col("date").cast("timestamp")) - F.unix_micros(F.col("p_date").cast("timestamp"))
    both = child.join(parent, (F.col("base_subject") == F.col("p_base_subject")) & (F.col("m") == F.col("p_m"))).where((apart > 0) & (apart <= days * 86_400 * 1_000_000) & (F.col("uid") != F.col("p_uid")))
    hit = lambda test, weight: F.when(F.coalesce(test, F.lit(False)), weight).otherwise(0.0)
    score = (
        F.when(gap <= 72, 0.10).otherwise(0.05)
        + 0.30
        + hit(F.col("reply_subject") == F.col("p_base_subject"), 0.15)
        + hit(F.lower("reply_from") == F.lower("p_sender_email"), 0.25)
        + hit(F.array_contains("p_participants", F.lower("sender_email")), 0.12)
        + hit(F.array_contains("participants", F.lower("p_sender_email")), 0.12)
        + hit((F.length("opening") > 0) & F.contains(F.col("p_opening"), F.substring("opening", 1, 40)), 0.08)
    )
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "p_uid")
    ranked = both.withColumn("score", F.round(score, 3)).withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("score").over(order))
    clear = F.col("second").isNull() | (F.col("score") - F.col("second") >= margin)
    return ranked.where((F.col("r") == 1) & (F.col("score") >= accept) & clear).select("uid", F.col("p_uid").alias("parent_uid"), F.least("score", F.lit(1.0)).alias("confidence"))
