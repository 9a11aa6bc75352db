"""Incremental ingestion in batch form, and its streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import archive as A
from ..operators import state
from ..streaming import ingest
from .registry import query


@query("""SELECT doc_id, text_hash FROM (SELECT doc_id, sha256(text) AS text_hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))) WHERE r = 1""")
def insert_if_absent(spark, sf):
    """Unlabelled documents arrive at an archive of the labelled ones: the first copy of each new text is stored."""
    docs = A.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    labels = A.table(spark, sf, "labels").select("doc_id")
    return state.insert_if_absent(docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti"), "text_hash", ["doc_id"]).select("doc_id", "text_hash")


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def journal_compaction(spark, sf):
    return state.compact(A.table(spark, sf, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("""SELECT c_custkey, c_name, CASE WHEN u.k IS NULL THEN c_acctbal ELSE u.total END AS c_acctbal FROM customer
    LEFT JOIN (SELECT o_custkey AS k, max_by(o_totalprice, o_orderkey) AS total, max_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1) u ON u.k = c_custkey
    WHERE u.k IS NULL OR u.status <> 'F'""")
def merge_latest(spark, sf):
    """The last order of a customer overwrites its balance; a finished one deletes the customer."""
    stored = A.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    orders = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("upsert").alias("operation"), F.col("o_orderkey").alias("sequence"))
    changes = orders.join(stored.select("c_custkey", "c_name"), "c_custkey")
    return state.merge_latest(stored, changes, "c_custkey", "sequence")


@query("SELECT doc_id, lang, TRUE AS tombstoned FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def tombstone_full_refresh(spark, sf):
    return state.tombstones(A.table(spark, sf, "documents").select("doc_id", "lang"), A.table(spark, sf, "labels"), ["doc_id"])


@query("""SELECT source AS folder, 1 AS generation, CASE WHEN good THEN high ELSE low END AS value, good AS advanced FROM (
    SELECT source, min(doc_id) AS low, max(doc_id) AS high, count(*) > 20 AS good FROM documents GROUP BY 1)""")
def cursor_progress(spark, sf):
    """Folders of more than twenty documents propose their last id from the right cursor, the others from a stale one."""
    sizes = A.table(spark, sf, "documents").groupBy(F.col("source").alias("folder")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    cursors = sizes.select("folder", F.lit(1).alias("generation"), F.col("low").alias("value"))
    proposals = sizes.select("folder", F.lit(1).alias("generation"), F.when(F.col("n") > 20, F.col("low")).otherwise(F.col("low") - 1).alias("expected"), F.col("high").alias("value"))
    return state.advance(cursors, proposals)


@query("""WITH v AS (SELECT user_id, event_id, event_type, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS fresh FROM events)
    SELECT user_id, event_type, event_id AS valid_from, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to FROM v WHERE fresh""")
def source_history(spark, sf):
    return state.history(A.table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", ["event_type"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def streaming_dedup(spark, sf):
    """Distinct (user, type) pairs, read as a stream to its end."""
    return ingest.run_to_end(spark, ingest.first_of_each(ingest.events(spark, sf), ["user_id", "event_type"]), "dedup").select("user_id", "event_type")


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def streaming_volume(spark, sf):
    """Daily counts of a stream with a watermark; the complete result once the stream has ended."""
    return ingest.run_to_end(spark, ingest.daily_counts(ingest.events(spark, sf)), "volume", mode="complete")


@query("""WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE AS fresh FROM events),
    s AS (SELECT *, sum(CASE WHEN coalesce(fresh, TRUE) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
    SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session""")
def streaming_sessions(spark, sf):
    return ingest.run_to_end(spark, ingest.sessions(ingest.events(spark, sf)), "sessions", mode="complete")


@query("SELECT user_id, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY 1")
def streaming_upsert(spark, sf):
    """Each micro-batch merged into a stored table, idempotent by batch id."""
    return ingest.upsert_to_end(spark, ingest.events(spark, sf))
