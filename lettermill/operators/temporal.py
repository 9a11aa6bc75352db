"""Time-based aggregates over messages (uid, date, sender_email, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def period(date: Column, unit: str) -> Column:
    """``2024-01-31``, ``2024-01-29/2024-02-04`` (Monday to Sunday) or ``2024-01``."""
    if unit == "week":
        monday = F.to_date(F.date_trunc("week", date))
        return F.concat(F.date_format(monday, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd"))
    return F.date_format(date, "yyyy-MM" if unit == "month" else "yyyy-MM-dd")


def in_zone(date: Column, zone: str) -> Column:
    """A UTC timestamp without zone as local time of ``zone``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), date)


def volume(messages: DataFrame, unit: str, zone: str = "UTC") -> DataFrame:
    date = F.col("date") if zone == "UTC" else in_zone(F.col("date"), zone)
    return messages.where("date is not null").groupBy(period(date, unit).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def iso_week(date: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), date), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def timeline(messages: DataFrame, unit: str) -> DataFrame:
    """Messages and senders per day, ISO week or month."""
    label = iso_week(F.col("date")) if unit == "week" else period(F.col("date"), unit)
    return messages.groupBy(label.alias("period")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sender_email").alias("senders"))


def heatmap(messages: DataFrame) -> DataFrame:
    """Weekday (0 is Monday) by hour, zero-filled."""
    counts = messages.groupBy(F.weekday("date").alias("day_of_week"), F.hour("date").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    grid = messages.sparkSession.range(168).select((F.col("id") / 24).cast("int").alias("day_of_week"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(counts, ["day_of_week", "hour"], "left").select("day_of_week", "hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def response_times(messages: DataFrame, original: str, reply: str) -> DataFrame:
    """Mean hours from each original to the sender's next reply, over all pairs."""
    later = Window.partitionBy("sender_email").orderBy("date", "uid").rowsBetween(1, Window.unboundedFollowing)
    rows = messages.withColumn("reply", F.min(F.when(F.expr(reply), F.col("date"))).over(later)).where(original).where("reply is not null")
    micros = lambda c: F.expr(f"unix_micros(cast({c} as timestamp))")
    hours = (micros("reply") - micros("date")) / 3_600_000_000
    return rows.groupBy(F.col("sender_email").alias("replier")).agg(F.round(F.avg(hours), 1).alias("avg_response_hours"), F.count(F.lit(1)).alias("response_count"))


def sessions(messages: DataFrame, gap: str) -> DataFrame:
    grouped = messages.groupBy("sender_email", F.session_window("date", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("sender_email", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
