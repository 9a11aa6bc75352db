"""Mail fields, search results and evidence items."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import archive as A
from ..functions import mail
from ..operators import evidence, results
from .registry import query


@query("SELECT event_id, strftime(CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE date_trunc('second', ts) - INTERVAL 2 HOUR END, '%Y-%m-%dT%H:%M:%S+00:00') AS sent FROM events")
def normalize_dates(spark, sf):
    """Half of the dates arrive as ISO text in UTC, half as mail dates two hours east."""
    at = F.col("ts").cast("timestamp")
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    mailed = F.concat(F.lit("Mon, "), F.date_format(at, "d MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    raw = F.when(F.col("event_id") % 2 == 0, iso).otherwise(mailed)
    return A.table(spark, sf, "events").select("event_id", mail.normalize_date(raw).alias("sent"))


@query("SELECT c_custkey, c_name AS name, lower(replace(c_name, '#', '.')) || '@example.com' AS address FROM customer")
def parse_addresses(spark, sf):
    raw = F.concat(F.lit('"'), "c_name", F.lit('" <'), F.regexp_replace("c_name", "#", "."), F.lit("@Example.com>"))
    return A.table(spark, sf, "customer").select("c_custkey", mail.parse_address(raw).alias("a")).select("c_custkey", "a.name", "a.address")


@query(f"""SELECT uid, 'Date: ' || strftime(date, '%Y-%m-%d') || chr(10) || 'From: ' || sender_email || chr(10) || 'Folder: ' || category AS header FROM {A.MESSAGES}""")
def chunk_headers(spark, sf):
    fields = {"Date": F.date_format("date", "yyyy-MM-dd"), "From": mail.sender_line(F.lit(None).cast("string"), F.col("sender_email")), "CC": F.lit(""), "Folder": F.col("category")}
    return A.messages(spark, sf).select("uid", mail.chunk_header(fields).alias("header"))


@query("""SELECT p_partkey, 'meta:' || sha256('{"content_id":"","filename":"' || lower(p_name) || '","mime_type":"' || lower(p_type) || '","size":' || p_size || '}') AS attachment_id FROM part""")
def attachment_ids(spark, sf):
    none = F.lit(None).cast("string")
    return A.table(spark, sf, "part").select("p_partkey", mail.attachment_id(F.col("p_name"), F.col("p_type"), F.col("p_size"), none, none).alias("attachment_id"))


@query(r"SELECT conv_id, turn, lower(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), '\s+', ' ', 'g'))) AS body FROM conversations")
def attachment_search_text(spark, sf):
    return A.table(spark, sf, "conversations").select("conv_id", "turn", mail.search_text(F.col("text")).alias("body"))


@query(r"SELECT page_id, CASE WHEN trim(regexp_replace(html, '<[^>]*>|&nbsp;', '', 'g')) <> '' THEN 'content' ELSE 'other' END AS kind FROM pages")
def body_states(spark, sf):
    none = F.lit(None).cast("string")
    shown = F.regexp_replace("html", r"<[^>]*>|&nbsp;", "")
    state = mail.body_state(shown, none, F.col("html"), none, none, F.lit("original"), F.lit(False))
    return A.table(spark, sf, "pages").select("page_id", F.when(state["kind"] == "content", "content").otherwise("other").alias("kind"))


# results


def _results(spark, sf):
    rows = A.messages(spark, sf)
    return rows.select(
        "uid", F.col("uid").alias("chunk_id"), F.lit("").alias("message_id"), "sender_email", F.lit(None).cast("string").alias("sender_name"), F.col("category").alias("subject"), F.col("category").alias("folder"), F.lit("").alias("cc"),
        F.lit("").alias("to"), F.lit("").alias("bcc"), F.lit("original").alias("email_type"), "date", F.when(F.col("category") == "purchase", "True").otherwise("False").alias("has_attachments"), F.lit("1").alias("priority"),
        F.lit("False").alias("is_calendar_message"), F.concat("category", F.lit(", all")).alias("categories"), F.concat("category", F.lit(".pdf")).alias("attachment_names"), F.array().cast("array<string>").alias("source_folders"),
        (F.col("value") / 100).alias("score"), F.when(F.col("category") == "view", "synthetic").otherwise("calibrated").alias("calibration"), F.col("props").alias("text"),
    )


@query(f"""SELECT uid FROM {A.MESSAGES} WHERE sender_email ILIKE '%user1%' AND date >= TIMESTAMP '2024-01-03' AND date < TIMESTAMP '2024-01-26' AND (category = 'view' OR value / 100 >= 0.2)""")
def result_filters(spark, sf):
    test = results.result_filter(sender="USER1", date_from="2024-01-03", date_to="2024-01-25", has_attachments=None, category="ALL", attachment_type="pdf", min_score=0.2)
    return _results(spark, sf).where(test).select("uid")


@query(f"SELECT uid FROM {A.MESSAGES} WHERE category = 'purchase'")
def result_filter_attachments(spark, sf):
    return _results(spark, sf).where(results.result_filter(has_attachments=True, folder="PURCH", priority=1, is_calendar=False, email_type="Original")).select("uid")


@query(f"SELECT uid FROM {A.MESSAGES} m WHERE EXISTS (SELECT 1 FROM documents d WHERE CAST(d.doc_id AS VARCHAR) = m.uid AND d.lang = 'en') AND EXISTS (SELECT 1 FROM labels l WHERE CAST(l.doc_id AS VARCHAR) = m.uid)")
def allowed_uids(spark, sf):
    english = A.documents(spark, sf).where("lang = 'en'").select("uid")
    labelled = A.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("uid"))
    return results.allowed(A.messages(spark, sf).select("uid"), english, labelled)


@query(f"""SELECT sender_email, subject, uid FROM (SELECT sender_email, category AS subject, uid, row_number() OVER (PARTITION BY sender_email, CAST(date AS DATE), category ORDER BY value / 100 DESC, uid) AS r FROM {A.MESSAGES}) WHERE r = 1""")
def best_per_message(spark, sf):
    rows = _results(spark, sf).withColumn("chunk_id", F.col("uid")).withColumn("uid", F.lit(""))
    return results.best_per_message(rows).select("sender_email", "subject", F.col("chunk_id").alias("uid"))


@query(f"SELECT uid, sender_email AS sender, strftime(date, '%Y-%m-%d') AS day, round(value / 100, 3) AS score, CASE WHEN length(props) > 7 THEN left(props, 7) || '...' ELSE props END AS preview FROM {A.MESSAGES}")
def triage(spark, sf):
    return results.triage(_results(spark, sf), 7)


@query(f"""(SELECT 'sender' AS kind, sender_email AS value, count(*) AS n FROM {A.MESSAGES} GROUP BY 2 ORDER BY n DESC, value LIMIT 10)
    UNION ALL (SELECT 'folder', source, count(*) AS n FROM documents GROUP BY 2 ORDER BY n DESC, source LIMIT 10)""")
def query_suggestions(spark, sf):
    return results.suggestions([("sender", A.messages(spark, sf), "sender_email"), ("folder", A.table(spark, sf, "documents"), "source")], 10)


@query(f"""SELECT sender_email AS conversation_id, round(max(value / 100), 6) AS top_score, max_by(uid, (value / 100, uid)) AS top_uid, count(DISTINCT uid) AS matches, string_agg(DISTINCT category, ',' ORDER BY category) AS participants, min(date) AS first_date, max(date) AS last_date
    FROM {A.MESSAGES} GROUP BY 1""")
def conversation_groups(spark, sf):
    rows = _results(spark, sf).select("uid", "score", "date", F.col("sender_email").alias("conversation_id"), F.col("subject").alias("sender_email"))
    return results.conversation_groups(rows).withColumn("top_score", F.round("top_score", 6))


@query("SELECT event_id AS uid FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels)")
def scan_session_unseen(spark, sf):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    seen = A.table(spark, sf, "labels").select(F.col("doc_id").alias("uid"), F.lit("2024-01-31 23:30:00").cast("timestamp").alias("seen_at"))
    return results.unseen(A.table(spark, sf, "events").select(F.col("event_id").alias("uid")), seen, now)[0]


@query(f"""WITH c AS (SELECT c.uid, p.uid AS parent_uid, round(CASE WHEN date_diff('second', p.date, c.date) <= 72 * 3600 THEN 0.10 ELSE 0.05 END + 0.30 + 0.15 + 0.25 + 0.12 + 0.12
            + CASE WHEN length(c.props) > 0 AND contains(p.props, left(c.props, 40)) THEN 0.08 ELSE 0 END, 3)::DOUBLE AS score
        FROM {A.MESSAGES} c JOIN {A.MESSAGES} p ON c.sender_email = p.sender_email AND c.category = 'purchase' AND p.category = 'error' AND p.date < c.date AND p.date >= c.date - INTERVAL 30 DAY),
    r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM c WINDOW w AS (PARTITION BY uid ORDER BY score DESC, parent_uid))
    SELECT uid, parent_uid, least(score, 1.0)::DOUBLE AS confidence FROM r WHERE r = 1 AND score >= 0.8 AND (second IS NULL OR score - second >= 0)""")
def inferred_parents(spark, sf):
    """A purchase's parent among the same user's errors."""
    rows = A.messages(spark, sf).select("uid", F.col("sender_email").alias("base_subject"), "date", "sender_email", F.array("sender_email").alias("participants"), F.col("props").alias("opening"), "category")
    children = rows.where("category = 'purchase'").withColumn("reply_from", F.col("sender_email")).withColumn("reply_subject", F.col("base_subject"))
    return results.infer_parents(children, rows.where("category = 'error'"), margin=0.0)


# evidence


@query("""SELECT item_id, least(5, greatest(1, item_id % 9 - 1))::INT AS relevance, left('category ' || item_id, 80) AS category, sha256(item_id || '|category ' || item_id || '|' || text) AS content_hash FROM benchmark""")
def evidence_items(spark, sf):
    rows = A.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("email_uid"), F.concat(F.lit("category "), "item_id").alias("category"), F.col("text").alias("key_quote"), (F.col("item_id") % 9 - 1).cast("int").alias("relevance"), "item_id")
    return evidence.new_items(rows).select("item_id", "relevance", "category", "content_hash")


@query("""SELECT item_id, 'E-' || row_number() OVER (ORDER BY item_id) AS label FROM benchmark""")
def evidence_numbers(spark, sf):
    return evidence.numbered(A.table(spark, sf, "benchmark").select("item_id"), "E", ["item_id"])


@query("""SELECT count(*) AS messages, count(DISTINCT sender_email) AS senders, strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day, count(DISTINCT category) AS folders
    FROM (SELECT 'user' || user_id AS sender_email, ts AS date, event_type AS category FROM events)""")
def archive_stats(spark, sf):
    return A.messages(spark, sf).agg(
        F.count(F.lit(1)).alias("messages"), F.count_distinct("sender_email").alias("senders"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_day"), F.count_distinct("category").alias("folders")
    )
