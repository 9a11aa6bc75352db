"""Counts, lists, pages, folders, visibility and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import archive as A
from ..operators import filters, visibility
from .registry import query


@query(f"SELECT count(*) AS n FROM {A.MESSAGES}")
def email_count(spark, sf):
    return A.messages(spark, sf).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(DISTINCT sender_email) AS n FROM {A.MESSAGES} WHERE sender_email <> ''")
def unique_sender_count(spark, sf):
    return A.messages(spark, sf).where("sender_email <> ''").agg(F.count_distinct("sender_email").alias("n"))


@query(f"SELECT min(date) AS first_date, max(date) AS last_date FROM {A.MESSAGES}")
def date_range(spark, sf):
    return A.messages(spark, sf).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(f"SELECT sender_email, count(*) AS n FROM {A.MESSAGES} GROUP BY 1 ORDER BY n DESC, sender_email LIMIT 20")
def top_senders(spark, sf):
    return A.messages(spark, sf).groupBy("sender_email").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sender_email").limit(20)


@query(f"SELECT category, count(*) AS n FROM {A.MESSAGES} GROUP BY 1")
def category_counts(spark, sf):
    return A.messages(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT uid, date, sender_email FROM {A.MESSAGES}
    WHERE category = 'purchase' AND date >= TIMESTAMP '2024-01-05' AND date < TIMESTAMP '2024-01-21' ORDER BY date, uid LIMIT 100""")
def calendar_emails(spark, sf):
    test = filters.message_filter(category="purchase", date_from="2024-01-05", date_to="2024-01-20")
    return A.messages(spark, sf).where(test).select("uid", "date", "sender_email").orderBy("date", "uid").limit(100)


@query(f"""SELECT uid, date, sender_email, category FROM {A.MESSAGES}
    WHERE sender_email ILIKE '%USER1%' ORDER BY sender_email DESC, uid LIMIT 25 OFFSET 50""")
def browse_page(spark, sf):
    rows = A.messages(spark, sf).where(filters.message_filter(sender="USER1")).select("uid", "date", "sender_email", "category")
    return filters.page(rows, "sender_email", descending=True, limit=25, offset=50)


@query(f"SELECT count(*) AS total FROM {A.MESSAGES} WHERE sender_email ILIKE '%USER1%'")
def browse_total(spark, sf):
    return A.messages(spark, sf).where(filters.message_filter(sender="USER1")).agg(F.count(F.lit(1)).alias("total"))


@query(f"""SELECT uid, sender_email, category, value FROM {A.MESSAGES}
    WHERE sender_email ILIKE '%user\\_%' ESCAPE '\\' OR (category = 'error' AND value >= 50 AND date >= TIMESTAMP '2024-01-10')""")
def filtered_messages(spark, sf):
    rows = A.messages(spark, sf)
    either = filters.contains_like(F.col("sender_email"), "user_") | filters.message_filter(category="error", date_from="2024-01-10", min_value=50)
    return rows.where(either).select("uid", "sender_email", "category", "value")


_STATE = f"(SELECT uid, bool_or(NOT tombstoned) AS active, bool_or(preexisting) AS preexisting FROM {A.SOURCES} GROUP BY 1)"
_MEMBERS = f"""(SELECT uid, folder FROM {A.SOURCES} WHERE NOT tombstoned
    UNION SELECT d.uid, d.folder FROM {A.DOCUMENTS} d LEFT JOIN {_STATE} s ON s.uid = d.uid WHERE coalesce(s.preexisting, TRUE))"""


@query(f"SELECT folder, count(DISTINCT uid) AS n FROM {_MEMBERS} WHERE folder <> '' GROUP BY 1")
def folder_counts_union(spark, sf):
    return visibility.folder_memberships(A.documents(spark, sf), A.sources(spark, sf)).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT uid, string_agg(DISTINCT folder, ',' ORDER BY folder) AS folders FROM {_MEMBERS} WHERE folder <> '' GROUP BY 1")
def effective_folders(spark, sf):
    return visibility.effective_folders(A.documents(spark, sf), A.sources(spark, sf)).select("uid", F.array_join("folders", ",").alias("folders"))


@query(f"SELECT d.uid, d.folder FROM {A.DOCUMENTS} d LEFT JOIN {_STATE} s ON s.uid = d.uid WHERE coalesce(s.active OR s.preexisting, TRUE)")
def visible_messages(spark, sf):
    return visibility.visible(A.documents(spark, sf), A.sources(spark, sf)).select("uid", "folder")


# set operations


@query("SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def set_union(spark, sf):
    labels = A.table(spark, sf, "labels")
    return labels.where("quality = 1").select("doc_id").union(labels.where("toxic = 1").select("doc_id")).distinct()


@query(f"SELECT sender AS contact, email_count AS n FROM {A.EDGES} UNION ALL SELECT recipient, email_count FROM {A.EDGES}")
def set_union_all(spark, sf):
    edges = A.edges(spark, sf)
    return edges.select(F.explode(F.array("sender", "recipient")).alias("contact"), F.col("email_count").alias("n"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersection(spark, sf):
    labels = A.table(spark, sf, "labels").where("quality = 1")
    return A.table(spark, sf, "documents").where("lang = 'en'").select("doc_id").join(labels, "doc_id", "left_semi").distinct()


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def set_difference_seen(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id").join(A.table(spark, sf, "labels"), "doc_id", "left_anti")


# windows and top-k


@query(f"""SELECT uid, sender_email, date, category FROM (SELECT *, row_number() OVER (PARTITION BY sender_email, CAST(date AS DATE), category ORDER BY value DESC, uid) AS r FROM {A.MESSAGES}) WHERE r = 1""")
def dedup_by_email(spark, sf):
    keys = Window.partitionBy("sender_email", F.to_date("date"), "category").orderBy(F.desc("value"), "uid")
    return A.messages(spark, sf).withColumn("r", F.row_number().over(keys)).where("r = 1").select("uid", "sender_email", "date", "category")


@query(f"SELECT sender_email, uid, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY sender_email ORDER BY date, uid) AS r FROM {A.MESSAGES}) WHERE r <= 64")
def per_uid_cap(spark, sf):
    order = Window.partitionBy("sender_email").orderBy("date", "uid")
    return A.messages(spark, sf).withColumn("place", F.row_number().over(order).cast("long")).where("place <= 64").select("sender_email", "uid", "place")


@query(f"""SELECT conversation_id, uid, tokens, used FROM (
        SELECT conversation_id, uid, greatest(1, length(left(coalesce(body, ''), 500)) // 4) AS tokens,
            sum(greatest(1, length(left(coalesce(body, ''), 500)) // 4)) OVER (PARTITION BY conversation_id ORDER BY turn)::BIGINT AS used,
            row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS r FROM {A.TURNS})
    WHERE used <= 300 OR r = 1""")
def response_budget(spark, sf):
    """Results until their tokens exceed the budget of a response; the first always stays."""
    order = Window.partitionBy("conversation_id").orderBy("turn")
    tokens = F.greatest(F.lit(1), F.floor(F.length(F.substring(F.coalesce("body", F.lit("")), 1, 500)) / 4)).cast("long")
    rows = A.turns(spark, sf).withColumn("tokens", tokens).withColumn("used", F.sum("tokens").over(order)).withColumn("r", F.row_number().over(order))
    return rows.where("used <= 300 or r = 1").select("conversation_id", "uid", "tokens", "used")


@query("""WITH ranked AS (
        SELECT label, vec_id, s, row_number() OVER w AS r, lead(s) OVER w AS following, count(*) OVER (PARTITION BY label) AS n
        FROM (SELECT label, vec_id, round(embedding[1]::DOUBLE, 4) AS s FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY s DESC, vec_id))
    SELECT label, vec_id, s AS score, n AS item_count,
        CASE WHEN n > 1 AND s - following <= 0.03 THEN 'ambiguous' WHEN s >= 0.85 AND s - coalesce(following, 0) >= 0.15 THEN 'high' WHEN s < 0.6 THEN 'low' ELSE 'medium' END AS confidence
    FROM ranked WHERE r = 1""")
def confidence_label(spark, sf):
    """The best item of each label and how sure it is: its score, and its lead over the next."""
    order = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    rows = A.table(spark, sf, "embeddings").select("label", "vec_id", F.round(F.col("embedding")[0].cast("double"), 4).alias("score"))
    ranked = rows.withColumn("r", F.row_number().over(order)).withColumn("following", F.lead("score").over(order)).withColumn("item_count", F.count(F.lit(1)).over(Window.partitionBy("label")))
    gap = F.col("score") - F.col("following")
    label = (
        F.when((F.col("item_count") > 1) & (gap <= 0.03), "ambiguous")
        .when((F.col("score") >= 0.85) & (F.col("score") - F.coalesce("following", F.lit(0.0)) >= 0.15), "high")
        .when(F.col("score") < 0.6, "low")
        .otherwise("medium")
    )
    return ranked.where("r = 1").select("label", "vec_id", "score", "item_count", label.alias("confidence"))


@query("""WITH lanes AS (SELECT event_type AS lane, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events)
    SELECT lane, event_id, value, r <= 2 AS reserved FROM lanes ORDER BY reserved DESC, value DESC, event_id LIMIT 50""")
def reserved_lane_selection(spark, sf):
    """Two places reserved for every lane, the rest filled by score."""
    order = Window.partitionBy("lane").orderBy(F.desc("value"), "event_id")
    rows = A.table(spark, sf, "events").select(F.col("event_type").alias("lane"), "event_id", "value").withColumn("reserved", F.row_number().over(order) <= 2)
    return rows.orderBy(F.desc("reserved"), F.desc("value"), "event_id").limit(50)
