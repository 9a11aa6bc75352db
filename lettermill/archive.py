"""Archive views: the relations of a message archive over the driver's tables.

``messages`` are events, ``documents`` carry bodies, ``turns`` are threads, edges
run from customers to suppliers, attachments are the parts of an order.  Every view
is a projection, so filters and column pruning reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line items for which a partition is planned where letters are shuffled.
LINES_A_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions for shuffles of letters, so that a task's share stays the same as they grow; None where the session's own number suffices."""
    n = -(-table(spark, sf_dir, "lineitem").count() // LINES_A_TASK)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(rows: DataFrame, n: int | None, *keys: str) -> DataFrame:
    return rows if n is None else rows.repartition(n, *keys)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("uid"), F.col("ts").alias("date"), F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.com")).alias("sender_email"),
        F.col("event_type").alias("category"), "value", "props",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uid"), "doc_id", F.col("text").alias("body"), "lang", F.col("source").alias("folder"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads: each turn replies to the one before it."""
    rows = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws(":", F.col("conv_id"), turn)
    return rows.select(
        name(F.col("turn")).alias("uid"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("in_reply_to"), F.col("conv_id").alias("conversation_id"), "turn",
        F.col("role").alias("sender"), F.col("text").alias("body"), F.when(F.col("turn") > 0, "reply").otherwise("original").alias("email_type"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote mappings of documents: a labelled document is mapped, a toxic one tombstoned, a good one was there before."""
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return labels.select(
        F.col("doc_id").cast("string").alias("uid"), F.concat(F.lit("Remote/"), "lang").alias("folder"), (F.col("toxic") == 1).alias("tombstoned"), (F.col("quality") == 1).alias("preexisting")
    )


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item: customer writes to supplier."""
    return _letters(spark, sf_dir, parts(spark, sf_dir))


def _letters(spark: SparkSession, sf_dir: str, n: int | None) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    lines, orders = spread(lines, n, "l_orderkey"), spread(orders, n, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("uid"), F.concat(F.lit("customer"), "o_custkey").alias("sender"), F.concat(F.lit("supplier"), "l_suppkey").alias("recipient"), F.col("o_orderdate").alias("date"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregated communication edges: sender, recipient, count, first, last."""
    n = parts(spark, sf_dir)
    return spread(_letters(spark, sf_dir, n), n, "sender", "recipient").groupBy("sender", "recipient").agg(F.count(F.lit(1)).alias("email_count"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = parts(spark, sf_dir)
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("."), F.lower("p_type")).alias("name"), F.col("p_size").cast("long").alias("size"), F.col("p_type").alias("mime_type"))
    # what is asked of attachments is mostly asked by letter
    return spread(_letters(spark, sf_dir, n).join(spread(items, n, "part"), "part").select("uid", "sender", "date", "line", "name", "size", "mime_type"), n, "uid")


# The same views for the oracle

MESSAGES = "(SELECT CAST(event_id AS VARCHAR) AS uid, ts AS date, 'user' || user_id || '@example.com' AS sender_email, event_type AS category, value, props FROM events)"
DOCUMENTS = "(SELECT CAST(doc_id AS VARCHAR) AS uid, doc_id, text AS body, lang, source AS folder FROM documents)"
TURNS = """(SELECT conv_id || ':' || turn AS uid, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS in_reply_to, conv_id AS conversation_id, turn,
    role AS sender, text AS body, CASE WHEN turn > 0 THEN 'reply' ELSE 'original' END AS email_type FROM conversations)"""
SOURCES = "(SELECT CAST(doc_id AS VARCHAR) AS uid, 'Remote/' || lang AS folder, toxic = 1 AS tombstoned, quality = 1 AS preexisting FROM labels JOIN documents USING (doc_id))"
LETTERS = """(SELECT o_orderkey AS uid, 'customer' || o_custkey AS sender, 'supplier' || l_suppkey AS recipient, o_orderdate AS date, l_partkey AS part, l_linenumber AS line
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
EDGES = f"(SELECT sender, recipient, count(*) AS email_count, min(date) AS first_seen, max(date) AS last_seen FROM {LETTERS} GROUP BY 1, 2)"
ATTACHMENTS = f"""(SELECT uid, sender, date, line, replace(p_name, ' ', '_') || '.' || lower(p_type) AS name, CAST(p_size AS BIGINT) AS size, p_type AS mime_type
    FROM {LETTERS} JOIN part ON p_partkey = part)"""
