"""Volumes, heat map, response times, timelines and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import archive as A
from ..operators import contacts, temporal, threads
from .registry import query


@query(f"SELECT strftime(date, '%Y-%m-%d') AS period, count(*) AS n FROM {A.MESSAGES} GROUP BY 1")
def volume_day(spark, sf):
    return temporal.volume(A.messages(spark, sf), "day")


@query(f"SELECT strftime(date_trunc('week', date), '%Y-%m-%d') || '/' || strftime(date_trunc('week', date) + INTERVAL 6 DAY, '%Y-%m-%d') AS period, count(*) AS n FROM {A.MESSAGES} GROUP BY 1")
def volume_week(spark, sf):
    return temporal.volume(A.messages(spark, sf), "week")


@query(f"SELECT strftime(date, '%Y-%m') AS period, count(*) AS n FROM {A.MESSAGES} GROUP BY 1")
def volume_month(spark, sf):
    return temporal.volume(A.messages(spark, sf), "month")


@query(f"""SELECT d AS day_of_week, h AS hour, count(m.date) AS n FROM (SELECT unnest(range(0, 7))::INT AS d) CROSS JOIN (SELECT unnest(range(0, 24))::INT AS h)
    LEFT JOIN {A.MESSAGES} m ON isodow(m.date) - 1 = d AND hour(m.date) = h GROUP BY 1, 2""")
def activity_heatmap(spark, sf):
    return temporal.heatmap(A.messages(spark, sf))


@query(f"""WITH e AS (SELECT sender_email, date, category, min(CASE WHEN category = 'purchase' THEN date END) OVER (PARTITION BY sender_email ORDER BY date, uid ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reply FROM {A.MESSAGES})
    SELECT sender_email AS replier, round(avg(date_diff('microsecond', date, reply) / 3600000000.0), 1) AS avg_response_hours, count(*) AS response_count
    FROM e WHERE category = 'error' AND reply IS NOT NULL GROUP BY 1""")
def response_times(spark, sf):
    """Hours from an error to the same user's next purchase."""
    return temporal.response_times(A.messages(spark, sf), "category = 'error'", "category = 'purchase'")


def _entity_timeline(fmt: str) -> str:
    return f"SELECT {fmt} AS period, count(*) AS n, count(DISTINCT sender_email) AS senders FROM {A.MESSAGES} WHERE category = 'signup' GROUP BY 1"


@query(_entity_timeline("strftime(date, '%Y-%m-%d')"))
def entity_timeline_day(spark, sf):
    return temporal.timeline(A.messages(spark, sf).where("category = 'signup'"), "day")


@query(_entity_timeline("isoyear(date) || '-W' || lpad(CAST(week(date) AS VARCHAR), 2, '0')"))
def entity_timeline_week(spark, sf):
    return temporal.timeline(A.messages(spark, sf).where("category = 'signup'"), "week")


@query(_entity_timeline("strftime(date, '%Y-%m')"))
def entity_timeline_month(spark, sf):
    return temporal.timeline(A.messages(spark, sf).where("category = 'signup'"), "month")


@query(f"""SELECT uid, sender_email, category, previous, previous IS NOT NULL AND category <> previous AS changed FROM (
    SELECT uid, sender_email, category, last_value(nullif(category, '') IGNORE NULLS) OVER (PARTITION BY sender_email ORDER BY date, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM {A.MESSAGES})""")
def timeline_transitions(spark, sf):
    return threads.transitions(A.messages(spark, sf), "sender_email", ["date", "uid"], "category").select("uid", "sender_email", "category", "previous", "changed")


_WINDOWS = f"""SELECT a.uid, a.date AS window_start, count(*) AS event_count, count(DISTINCT b.sender_email)::INT AS senders
    FROM {A.MESSAGES} a JOIN {A.MESSAGES} b ON b.date >= a.date AND b.date <= a.date + INTERVAL 1 HOUR AND a.category = 'error' AND b.category = 'error'
    GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT b.sender_email) >= 2"""


@query(_WINDOWS)
def coordinated_timing(spark, sf):
    return contacts.coordinated_windows(A.messages(spark, sf).where("category = 'error'"), hours=1)


@query(f"""WITH RECURSIVE w AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY window_start, uid) AS place FROM ({_WINDOWS})),
    n AS MATERIALIZED (SELECT a.place, min(b.place) AS following FROM w a LEFT JOIN w b ON b.window_start > a.window_start + INTERVAL 1 HOUR GROUP BY 1),
    p AS (SELECT min(place) AS place FROM w UNION ALL SELECT n.following FROM p JOIN n ON n.place = p.place WHERE n.following IS NOT NULL)
    SELECT uid, window_start, event_count, senders FROM p JOIN w USING (place)""")
def coordinated_timing_greedy(spark, sf):
    """The windows that remain when each starts after the one before has ended."""
    rows = A.messages(spark, sf).where("category = 'error'")
    return contacts.pick_windows(contacts.coordinated_windows(rows, hours=1), hours=1)


@query(f"""WITH e AS (SELECT *, date - lag(date) OVER (PARTITION BY sender_email ORDER BY date) >= INTERVAL 30 MINUTE AS fresh FROM {A.MESSAGES}),
    s AS (SELECT *, sum(CASE WHEN coalesce(fresh, TRUE) THEN 1 ELSE 0 END) OVER (PARTITION BY sender_email ORDER BY date) AS session FROM e)
    SELECT sender_email, min(date) AS started, max(date) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY sender_email, session""")
def session_windows(spark, sf):
    return temporal.sessions(A.messages(spark, sf), "30 minutes")


@query(f"""SELECT conversation_id, count(*) AS messages, string_agg(DISTINCT sender, ',' ORDER BY sender) AS participants, min_by(sender, turn) AS first_sender, max_by(sender, turn) AS last_sender,
    sum(length(body))::BIGINT AS chars FROM {A.TURNS} GROUP BY 1""")
def thread_summaries(spark, sf):
    return threads.summaries(A.turns(spark, sf))


@query(f"SELECT strftime(date, '%Y-%m') AS month, sender, count(*) AS n FROM {A.LETTERS} GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY month ORDER BY n DESC, sender) <= 15")
def monthly_top_senders(spark, sf):
    """The report's fifteen busiest senders of each month."""
    rows = A.letters(spark, sf).groupBy(F.date_format("date", "yyyy-MM").alias("month"), "sender").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("month").orderBy(F.desc("n"), "sender")
    return rows.withColumn("r", F.row_number().over(order)).where("r <= 15").drop("r")
