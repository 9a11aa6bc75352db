"""Hydration, threads, ingest state, text surfaces, and the summaries that reports are made of."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import archive as A
from ..functions import text
from ..operators import context
from .bodies import _TOP_TERMS
from .registry import query

# hydration

_FULL = f"""WITH r AS (SELECT uid, string_agg(DISTINCT recipient, ',' ORDER BY recipient) AS recipients FROM {A.LETTERS} GROUP BY 1),
    f AS (SELECT uid, string_agg(name || ':' || size, ';' ORDER BY line, name, size) AS files, count(*) AS n FROM {A.ATTACHMENTS} GROUP BY 1)
    SELECT o_orderkey AS uid, 'customer' || o_custkey AS sender, o_orderdate AS date, o_orderpriority AS category, coalesce(recipients, '') AS recipients, coalesce(files, '') AS files, coalesce(n, 0)::INT AS n_files
    FROM orders LEFT JOIN r ON r.uid = o_orderkey LEFT JOIN f ON f.uid = o_orderkey"""


def _hydrated(spark, sf, uids=None):
    orders = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"), F.concat(F.lit("customer"), "o_custkey").alias("sender"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("category"))
    full = context.hydrate(orders, A.letters(spark, sf).select("uid", "recipient"), A.attachments(spark, sf), uids)
    files = F.transform("attachments", lambda a: F.concat_ws(":", a["name"], a["size"].cast("string")))
    return full.select("uid", "sender", "date", "category", F.array_join("recipients", ",").alias("recipients"), F.array_join(files, ";").alias("files"), F.size("attachments").alias("n_files"))


@query(_FULL)
def full_hydration(spark, sf):
    return _hydrated(spark, sf)


@query(_FULL + " WHERE o_orderstatus = 'P'")
def batch_hydration(spark, sf):
    """The messages of a list of uids, whatever its length."""
    return _hydrated(spark, sf, A.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("uid")))


@query(f"""SELECT uid, coalesce(files, '') AS files, coalesce(len(string_split(files, ',')), 0)::INT AS n FROM (SELECT o_orderkey AS uid FROM orders)
    LEFT JOIN (SELECT uid, string_agg(name, ',' ORDER BY name) AS files FROM (SELECT DISTINCT uid, name FROM {A.ATTACHMENTS}) GROUP BY 1) USING (uid)""")
def entity_reextraction_concat(spark, sf):
    """What an entity run reads of a message's attachments, aggregated before the join."""
    names = A.attachments(spark, sf).groupBy("uid").agg(F.array_sort(F.collect_set("name")).alias("names"))
    rows = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("uid")).join(names, "uid", "left")
    return rows.select("uid", F.coalesce(F.array_join("names", ","), F.lit("")).alias("files"), F.coalesce(F.size("names"), F.lit(0)).alias("n")).withColumn("n", F.greatest("n", F.lit(0)))


@query("SELECT CAST(doc_id AS VARCHAR) AS uid, coalesce(source, 'Unknown') AS folder, coalesce(lang, 'unknown') AS language, sha256(text) AS body_sha256 FROM documents WHERE trim(coalesce(text, '')) <> ''")
def reembed_projection(spark, sf):
    rows = context.embedding_input(A.documents(spark, sf).withColumnRenamed("lang", "language"), "body", {"folder": "Unknown", "language": "unknown"})
    return rows.select("uid", "folder", "language", F.sha2("body", 256).alias("body_sha256"))


@query("SELECT event_id, event_type || ', ' || user_id AS labels, CAST(to_json({'event_type': event_type, 'user_id': user_id}) AS VARCHAR) AS record, CAST(user_id AS VARCHAR) AS plain FROM events")
def chunk_metadata_scalars(spark, sf):
    rows = A.table(spark, sf, "events").select("event_id", F.array("event_type", F.col("user_id").cast("string")).alias("labels"), F.struct("event_type", "user_id").alias("record"), F.col("user_id").alias("plain"))
    return rows.select("event_id", *(context.scalar(rows, c).alias(c) for c in ("labels", "record", "plain")))


# threads

_THREADED = "(SELECT CAST(event_id AS VARCHAR) AS uid, CASE WHEN user_id % 3 = 0 THEN 't' || user_id ELSE '' END AS conversation_id, 't' || (user_id % 50) AS inferred_thread_id, ts AS date FROM events)"


@query(f"""WITH t AS (SELECT DISTINCT inferred_thread_id AS thread_id FROM {_THREADED}), e AS (SELECT thread_id, uid, date FROM t JOIN {_THREADED} ON conversation_id = thread_id),
    i AS (SELECT thread_id, uid, date FROM t JOIN {_THREADED} ON inferred_thread_id = thread_id WHERE thread_id NOT IN (SELECT thread_id FROM e))
    SELECT thread_id, uid, row_number() OVER (PARTITION BY thread_id ORDER BY date, uid)::INT AS place FROM (SELECT * FROM e UNION ALL SELECT * FROM i)""")
def thread_emails(spark, sf):
    """A third of the users name their thread; the others' messages are found by the inferred one."""
    user = F.col("user_id")
    rows = A.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("uid"), F.when(user % 3 == 0, F.concat(F.lit("t"), user)).otherwise("").alias("conversation_id"), F.concat(F.lit("t"), user % 50).alias("inferred_thread_id"), F.col("ts").alias("date"))
    found = context.thread_members(rows, rows.select(F.col("inferred_thread_id").alias("thread_id")).distinct())
    return found.select("thread_id", "uid", context.thread_place(F.col("date"), F.lit(""), F.col("uid"), "thread_id").alias("place"))


@query("""WITH r AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN 'day ' || (event_id % 5) WHEN event_id % 11 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS raw FROM events)
    SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY try_strptime(raw, '%Y-%m-%dT%H:%M:%S') NULLS LAST, raw, CAST(event_id AS VARCHAR))::INT AS place FROM r""")
def thread_order(spark, sf):
    """Messages of a user in thread order; some dates cannot be read."""
    raw = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("day "), F.col("event_id") % 5)).when(F.col("event_id") % 11 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = A.table(spark, sf, "events").select("event_id", "user_id", raw.alias("raw"))
    at = F.try_to_timestamp("raw", F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return rows.select("event_id", context.thread_place(at, F.col("raw"), F.col("event_id").cast("string"), "user_id").alias("place"))


@query("""WITH m AS (SELECT DISTINCT conv_id, turn FROM conversations), d AS (SELECT c.conv_id, c.turn, p.turn AS parent FROM m c JOIN m p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 WHERE c.turn % 3 = 1),
    r AS (SELECT c.conv_id, c.turn, max(p.turn) AS parent FROM m c JOIN m p ON p.conv_id = c.conv_id AND p.turn <= c.turn - 2 GROUP BY 1, 2)
    SELECT m.conv_id || ':' || m.turn AS uid, m.conv_id || ':' || coalesce(d.parent, r.parent) AS parent_uid, CASE WHEN d.parent IS NOT NULL THEN 'in_reply_to' ELSE 'references' END AS via
    FROM m LEFT JOIN d USING (conv_id, turn) LEFT JOIN r USING (conv_id, turn) WHERE coalesce(d.parent, r.parent) IS NOT NULL""")
def header_parents(spark, sf):
    """A third of the turns name the turn before; the references of all end two turns before, then with a lost one."""
    name = lambda turn: F.concat_ws(":", F.col("conv_id"), turn)
    turns = A.table(spark, sf, "conversations").select("conv_id", "turn").distinct()
    earlier = F.when(F.col("turn") >= 2, F.transform(F.sequence(F.lit(0).cast("long"), F.col("turn") - 2), lambda k: F.concat(F.lit("<"), F.col("conv_id"), F.lit(":"), k, F.lit(">")))).otherwise(F.array().cast("array<string>"))
    direct = F.when(F.col("turn") % 3 == 1, name(F.col("turn") - 1)).when(F.col("turn") % 3 == 2, "lost").otherwise("")
    children = turns.select(name(F.col("turn")).alias("uid"), direct.alias("in_reply_to"), F.concat(earlier, F.array(F.lit("<lost>"))).alias("references"))
    archive = turns.select(name(F.col("turn")).alias("uid"), F.concat(F.lit("<"), name(F.col("turn")), F.lit(">")).alias("message_id"), F.lit("").alias("thread_id"), F.col("turn").alias("date"))
    return context.header_parents(children, archive)


# ingest state

_STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END"
_LEDGER = f"""(SELECT user_id AS uid, s.status AS status, s.files AS attachment_status, failures FROM (SELECT user_id, max_by({{'status': {_STATUS}, 'files': CASE WHEN value > 50 THEN 'completed' ELSE 'degraded' END}}, (ts, event_id)) AS s,
    count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1))"""


def _ledger(spark, sf):
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("pending")
    files = F.when(F.col("value") > 50, "completed").otherwise("degraded")
    return context.ledger(A.table(spark, sf, "events").select(F.col("user_id").alias("uid"), status.alias("status"), files.alias("attachment_status"), F.col("ts").alias("at"), F.col("event_id").alias("mark")))


@query(f"SELECT * FROM {_LEDGER}")
def ingest_ledger(spark, sf):
    return _ledger(spark, sf)


@query(f"SELECT uid FROM {_LEDGER} JOIN customer ON c_custkey = uid WHERE status = 'completed'")
def completed_ingest(spark, sf):
    customers = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), (F.col("c_nationkey") % 2 == 1).alias("has_attachments"))
    return context.completed(_ledger(spark, sf), customers)


@query(f"SELECT uid FROM {_LEDGER} JOIN customer ON c_custkey = uid WHERE status = 'pending' AND attachment_status = 'degraded' AND c_nationkey % 2 = 1")
def attachment_reprocessing(spark, sf):
    """Messages with attachments whose ledger says that these were degraded: what a reprocessing run reads again."""
    wanted = _ledger(spark, sf).where("status = 'pending' and attachment_status = 'degraded'").select("uid")
    return A.table(spark, sf, "customer").where("c_nationkey % 2 = 1").select(F.col("c_custkey").alias("uid")).join(wanted, "uid", "left_semi")


_MENTIONS = """SELECT coalesce(a.user_id, b.user_id) AS user_id, {0} AS mentions FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) a
    FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) b ON a.user_id = b.user_id"""


def _mentions(spark, sf, again):
    count = lambda kind: A.table(spark, sf, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.count(F.lit(1)).alias("mentions"))
    return context.merge_mentions(count("click"), count("view"), ["user_id"], again)


@query(_MENTIONS.format("coalesce(a.n, 0) + coalesce(b.n, 0)"))
def mention_counts_increment(spark, sf):
    return _mentions(spark, sf, False)


@query(_MENTIONS.format("greatest(coalesce(a.n, 0), coalesce(b.n, 0))"))
def mention_counts_idempotent(spark, sf):
    return _mentions(spark, sf, True)


# text surfaces

_KIND = "CASE role WHEN 'user' THEN 'authored_body' WHEN 'assistant' THEN 'quoted_reply' ELSE 'header_block' END"
_OF = lambda kind: f"CASE WHEN kind = '{kind}' THEN text END"
_PIVOT = f"""(SELECT conv_id AS uid, {", ".join(f"string_agg({t}, chr(10) ORDER BY turn, text) AS {n}_text, min(CASE WHEN {c} THEN turn END) AS {n}_ordinal" for n, t, c in (
    ("authored_segment", _OF("authored_body"), "kind = 'authored_body'"), ("quoted_segment", _OF("quoted_reply"), "kind = 'quoted_reply'"), ("forwarded_header", _OF("header_block"), "kind = 'header_block'"), ("segment", "text", "true")))}
    FROM (SELECT *, {_KIND} AS kind FROM conversations) GROUP BY 1)"""


def _pivot(spark, sf):
    kind = F.when(F.col("role") == "user", "authored_body").when(F.col("role") == "assistant", "quoted_reply").otherwise("header_block")
    return context.segment_pivot(A.table(spark, sf, "conversations").select(F.col("conv_id").alias("uid"), F.col("turn").alias("ordinal"), kind.alias("segment_type"), "text"))


@query(f"""SELECT uid, {", ".join(f"sha256({n}_text) AS {n}_sha256, {n}_ordinal" for n in context.SEGMENT_GROUPS)} FROM {_PIVOT}""")
def segment_pivot(spark, sf):
    rows = _pivot(spark, sf)
    return rows.select("uid", *(c for n in context.SEGMENT_GROUPS for c in (F.sha2(f"{n}_text", 256).alias(f"{n}_sha256"), F.col(f"{n}_ordinal"))))


@query(f"""SELECT uid, scope, source, ordinal, length(text) AS chars FROM (
    {" UNION ALL ".join(f"SELECT uid, '{scope}' AS scope, 'message_segments' AS source, {n}_ordinal AS ordinal, {n}_text AS text FROM {_PIVOT}" for scope, n in (("authored_body", "authored_segment"), ("quoted_body", "quoted_segment"), ("forwarded_header", "forwarded_header"), ("segment_text", "segment")))})
    WHERE trim(coalesce(text, '')) <> ''""")
def surface_language_rows(spark, sf):
    return context.surface_rows(_pivot(spark, sf)).select("uid", "scope", "source", "ordinal", F.length("text").cast("long").alias("chars"))


_SURFACES = """(SELECT doc_id, trim(coalesce(source, '')) AS subject, CASE WHEN doc_id % 3 = 0 THEN trim(text) ELSE '' END AS authored, CASE WHEN doc_id % 3 = 1 THEN trim(left(text, 60)) ELSE '' END AS forensic, CASE WHEN doc_id % 5 < 4 THEN trim(left(text, 25)) ELSE '' END AS body FROM documents)"""


@query(rf"""WITH s AS (SELECT *, len(regexp_extract_all(forensic, '\S+')) < 8 AS sf, len(regexp_extract_all(body, '\S+')) < 8 AS sb FROM {_SURFACES}),
    t AS (SELECT doc_id, CASE WHEN authored <> '' THEN 'segment:authored_body' WHEN forensic <> '' AND subject <> '' AND sf THEN 'subject_plus_forensic_body_text' WHEN forensic <> '' THEN 'forensic_body_text'
        WHEN body <> '' AND subject <> '' AND sb THEN 'subject_plus_body_text' WHEN body <> '' THEN 'body_text' WHEN subject <> '' THEN 'subject' ELSE '' END AS source, * EXCLUDE doc_id FROM s)
    SELECT doc_id, source, sha256(CASE source WHEN 'segment:authored_body' THEN authored WHEN 'subject_plus_forensic_body_text' THEN subject || chr(10) || forensic WHEN 'forensic_body_text' THEN forensic
        WHEN 'subject_plus_body_text' THEN subject || chr(10) || body WHEN 'body_text' THEN body WHEN 'subject' THEN subject ELSE '' END) AS text_sha256 FROM t""")
def analytics_text(spark, sf):
    doc, body = F.col("doc_id"), F.col("text")
    chosen = context.analytics_text(
        F.col("source"), F.when(doc % 3 == 0, body), [("forensic_body_text", F.when(doc % 3 == 1, F.left(body, F.lit(60)))), ("body_text", F.when(doc % 5 < 4, F.left(body, F.lit(25))))], F.lit("")
    )
    return A.table(spark, sf, "documents").select("doc_id", chosen.alias("c")).select("doc_id", "c.source", F.sha2("c.text", 256).alias("text_sha256"))


@query(r"""WITH p AS (SELECT doc_id, [trim(coalesce(source, '')), trim(text), trim(left(text, 40)), trim(text)] AS p FROM documents),
    k AS (SELECT doc_id, list_filter(p, lambda x, i: x <> '' AND list_position(p, x) = i) AS t, list_filter(['subject', 'forensic_body_text', 'body_text', 'raw_body_text'], lambda x, i: p[i] <> '' AND list_position(p, p[i]) = i) AS n FROM p),
    j AS (SELECT doc_id, array_to_string(t, chr(10)) AS t, array_to_string(n, '+') AS sources FROM k)
    SELECT doc_id, sources, sha256(CASE WHEN length(t) > 12000 THEN regexp_replace(left(t, 8040), '\s+\z', '') || chr(10) || '[... entity text truncated for extraction ...]' || chr(10) || regexp_replace(right(t, 3960), '\A\s+', '') ELSE t END) AS text_sha256 FROM j""")
def entity_text(spark, sf):
    body = F.col("text")
    chosen = context.entity_text([("subject", F.col("source")), ("forensic_body_text", body), ("body_text", F.left(body, F.lit(40))), ("raw_body_text", body)])
    return A.table(spark, sf, "documents").select("doc_id", chosen.alias("c")).select("doc_id", "c.sources", F.sha2("c.text", 256).alias("text_sha256"))


@query("""WITH p AS (SELECT doc_id, term, string_split(lower(text), term) AS p, text FROM documents, (SELECT unnest(['and', 'der', 'e-mail']) AS term)),
    o AS (SELECT doc_id, term, text, unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(term)))::INT AS start FROM p WHERE len(p) > 1)
    SELECT doc_id, term, start, start + length(term)::INT AS stop, substring(text, start + 1, length(term)) AS surface FROM o""")
def entity_occurrences(spark, sf):
    """Every place of three terms, a row each, with the surface as written."""
    rows = A.table(spark, sf, "documents").select("doc_id", "text", F.explode(F.array(F.lit("and"), F.lit("der"), F.lit("e-mail"))).alias("term"))
    return context.occurrences(rows, "doc_id", "text", "term").select("doc_id", "term", "start", "stop", "surface")


@query(r"""WITH s AS (SELECT doc_id, text, trim(substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 31, 50)) AS snippet FROM documents WHERE length(text) > 120),
    f AS (SELECT *, CASE WHEN contains(text, snippet) THEN snippet ELSE regexp_extract(text, array_to_string(list_transform(string_split(snippet, ' '), lambda w: regexp_escape(w)), '\s+')) END AS found FROM s WHERE snippet <> '')
    SELECT doc_id, (instr(text, found) - 1)::INT AS start, (instr(text, found) - 1 + length(found))::INT AS stop, CASE WHEN contains(text, snippet) THEN 'exact' ELSE 'collapsed' END AS mode FROM f WHERE found <> ''""")
def snippet_bounds(spark, sf):
    """Where a snippet of the squeezed text stands in the text as written."""
    rows = A.table(spark, sf, "documents").where(F.length("text") > 120).select("doc_id", "text", F.trim(F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 31, 50)).alias("snippet"))
    found = rows.where("snippet <> ''").select("doc_id", context.snippet_bounds(F.col("text"), F.col("snippet")).alias("b")).where("b is not null")
    return found.select("doc_id", "b.start", "b.stop", "b.mode")


@query(r"SELECT event_id, replace(CASE WHEN hour(ts) > 0 OR minute(ts) > 0 THEN strftime(ts, '%B %d, %Y, %I:%M %p') ELSE strftime(ts, '%B %d, %Y') END, ' 0', ' ') AS date, CASE WHEN user_id * 997 < 1024 THEN (user_id * 997) || ' B' WHEN user_id * 997 < 1048576 THEN printf('%.1f KB', user_id * 997 / 1024) ELSE printf('%.1f MB', user_id * 997 / 1048576) END AS size FROM events")
def display_formats(spark, sf):
    rows = A.table(spark, sf, "events")
    return rows.select("event_id", context.display_date(F.col("ts")).alias("date"), context.display_size(F.col("user_id") * 997).alias("size"))


@query(r"""SELECT doc_id, sha256(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) AS text_sha256 FROM documents""")
def control_characters(spark, sf):
    """Texts wrapped in a terminal escape and a bell come back clean."""
    marked = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x07\x1b[0m"))
    return A.table(spark, sf, "documents").select("doc_id", F.sha2(text.sanitize(marked), 256).alias("text_sha256"))


# summaries


@query("""WITH s AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1), t AS (SELECT count(*) AS total, count(lang) AS labeled FROM documents),
    l AS (SELECT count(*) AS metadata, count(*) FILTER (quality = 0) AS low FROM labels), d AS (SELECT lang, n FROM s ORDER BY n DESC, lang LIMIT 1)
    SELECT total, labeled, total - labeled AS unlabeled, round(labeled / total, 4) AS labeled_share, round(metadata / total, 4) AS metadata_share, low, lang AS dominant, round(n / total, 4) AS dominant_total_share, round(n / labeled, 4) AS dominant_labeled_share FROM t, l, d""")
def language_coverage(spark, sf):
    """Shares of labelled documents, of the dominant language and of language metadata."""
    docs = A.table(spark, sf, "documents")
    counts = docs.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("m"), "lang")).alias("d"))
    total = docs.agg(F.count(F.lit(1)).alias("total"), F.count("lang").alias("labeled"))
    metadata = A.table(spark, sf, "labels").agg(F.count(F.lit(1)).alias("metadata"), F.count_if(F.col("quality") == 0).alias("low"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    n, c = -F.col("d.m"), F.col
    return total.crossJoin(metadata).crossJoin(counts).select(
        "total", "labeled", (c("total") - c("labeled")).alias("unlabeled"), share(c("labeled"), c("total")).alias("labeled_share"), share(c("metadata"), c("total")).alias("metadata_share"), "low",
        c("d.lang").alias("dominant"), share(n, c("total")).alias("dominant_total_share"), share(n, c("labeled")).alias("dominant_labeled_share"),
    )


@query(f"""WITH i AS (SELECT * FROM {A.MESSAGES}), c AS (SELECT category, count(*) AS n FROM i GROUP BY 1)
    SELECT count(*) AS items, count(DISTINCT category) AS categories, (SELECT category FROM c ORDER BY n DESC, category LIMIT 1) AS dominant, strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day,
        count(*) FILTER (value > 50) AS verified, count(*) FILTER (NOT value > 50) AS unverified, count(*) > 0 AND count(*) FILTER (NOT value > 50) = 0 AS all_verified, count(DISTINCT sender_email) AS senders FROM i""")
def dossier_summary(spark, sf):
    rows = A.messages(spark, sf).withColumn("verified", F.col("value") > 50)
    first = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("categories"), F.min(F.struct((-F.col("n")).alias("m"), "category"))["category"].alias("dominant"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    unverified = F.count_if(~F.col("verified"))
    whole = rows.agg(
        F.count(F.lit(1)).alias("items"), day(F.min("date")).alias("first_day"), day(F.max("date")).alias("last_day"), F.count_if("verified").alias("verified"), unverified.alias("unverified"),
        ((F.count(F.lit(1)) > 0) & (unverified == 0)).alias("all_verified"), F.count_distinct("sender_email").alias("senders"),
    )
    return whole.crossJoin(first)


@query("SELECT kind, label, count(*) AS n FROM (SELECT 'label' AS kind, CASE WHEN quality = 1 THEN 'relevant' ELSE 'bycatch' END AS label FROM labels UNION ALL SELECT 'phase', CAST(toxic AS VARCHAR) FROM labels) GROUP BY 1, 2")
def scan_session_counts(spark, sf):
    """How many candidates of a scan have each label and each phase, from one pass."""
    each = F.array(F.struct(F.lit("label").alias("kind"), F.when(F.col("quality") == 1, "relevant").otherwise("bycatch").alias("label")), F.struct(F.lit("phase").alias("kind"), F.col("toxic").cast("string").alias("label")))
    return A.table(spark, sf, "labels").select(F.inline(each)).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT count(*) AS seen, count(*) FILTER (size >= 25) AS rich, round(count(*) FILTER (size >= 25) / count(*), 4) AS rich_ratio, count(*) FILTER (size < 5) AS ocr_only, round(count(*) FILTER (size < 5) / count(*), 4) AS ocr_ratio,
    count(*) - count(DISTINCT name) AS duplicates FROM {A.ATTACHMENTS}""")
def attachment_telemetry(spark, sf):
    rows, n = A.attachments(spark, sf), F.count(F.lit(1))
    rich, ocr = F.count_if(F.col("size") >= 25), F.count_if(F.col("size") < 5)
    return rows.agg(n.alias("seen"), rich.alias("rich"), F.round(rich / n, 4).alias("rich_ratio"), ocr.alias("ocr_only"), F.round(ocr / n, 4).alias("ocr_ratio"), (n - F.count_distinct("name")).alias("duplicates"))


@query("SELECT count(*) AS vectors, min(len(embedding)) AS least_size, max(len(embedding)) AS most_size, min(label) = max(label) AS one_label, count(DISTINCT label) AS labels FROM embeddings")
def vector_stats(spark, sf):
    size = F.size("embedding").cast("long")
    return A.table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("vectors"), F.min(size).alias("least_size"), F.max(size).alias("most_size"), (F.min("label") == F.max("label")).alias("one_label"), F.count_distinct("label").alias("labels"))


@query(f"""WITH v AS (SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM {A.SOURCES} s WHERE s.uid = CAST(d.doc_id AS VARCHAR) AND NOT s.tombstoned AND s.folder = 'Remote/en')
        OR ((NOT EXISTS (SELECT 1 FROM {A.SOURCES} s WHERE s.uid = CAST(d.doc_id AS VARCHAR)) OR EXISTS (SELECT 1 FROM {A.SOURCES} s WHERE s.uid = CAST(d.doc_id AS VARCHAR) AND s.preexisting)) AND 'Remote/' || d.lang = 'Remote/en'))
    SELECT term, round(avg(weight), 4) AS score, count(DISTINCT doc_id) AS documents FROM ({_TOP_TERMS}) WHERE doc_id IN (SELECT doc_id FROM v) GROUP BY 1""")
def folder_keywords(spark, sf):
    """Keywords of the documents that are in a folder: by an active mapping, or, unmapped or there before, by their own."""
    from ..operators import learning

    docs = A.table(spark, sf, "documents")
    sources = A.sources(spark, sf).select(F.col("uid").cast("long").alias("doc_id"), "folder", "tombstoned", "preexisting")
    ids = docs.select("doc_id", F.concat(F.lit("Remote/"), "lang").alias("own"))
    mapped = ids.join(sources.where("not tombstoned and folder = 'Remote/en'"), "doc_id", "left_semi")
    mine = ids.where("own = 'Remote/en'")
    kept = mapped.select("doc_id").union(mine.join(sources, "doc_id", "left_anti").select("doc_id")).union(mine.join(sources.where("preexisting"), "doc_id", "left_semi").select("doc_id")).distinct()
    terms = learning.top_terms(docs, "doc_id", "text", 5).join(kept, "doc_id", "left_semi")
    return terms.groupBy("term").agg(F.round(F.avg("weight"), 4).alias("score"), F.count_distinct("doc_id").alias("documents"))


@query("""SELECT vec_id, label, place FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id)::INT AS place FROM embeddings) WHERE place <= 30""")
def topic_members(spark, sf):
    """The members of each topic of the greatest weight."""
    weight = F.col("embedding")[0]
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(weight), "vec_id"))
    return A.table(spark, sf, "embeddings").withColumn("place", place).where("place <= 30").select("vec_id", "label", "place")


@query("SELECT event_id, event_type FROM events WHERE coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) <> 7")
def stale_generation(spark, sf):
    from ..operators import state

    rows = A.table(spark, sf, "events").withColumn("generation", F.get_json_object("props", "$.k"))
    return state.stale(rows, "7", "generation").select("event_id", "event_type")


# composites


@query(f"""SELECT 'overview' AS section, 'messages' AS item, count(*) AS n FROM {A.MESSAGES} UNION ALL SELECT 'overview', 'senders', count(DISTINCT sender_email) FROM {A.MESSAGES}
    UNION ALL (SELECT 'sender', sender_email, count(*) AS n FROM {A.MESSAGES} GROUP BY 2 ORDER BY n DESC, sender_email LIMIT 15) UNION ALL SELECT 'folder', category, count(*) FROM {A.MESSAGES} GROUP BY 2
    UNION ALL SELECT 'month', strftime(date, '%Y-%m'), count(*) FROM {A.MESSAGES} GROUP BY 2
    UNION ALL (SELECT 'entity', entity, count(DISTINCT page_id) AS n FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS entity FROM pages) WHERE entity <> '' GROUP BY 2 ORDER BY n DESC, entity LIMIT 20)""")
def archive_report(spark, sf):
    """The figures of the report: overview, top senders, folders, monthly volume, top entities."""
    rows = A.messages(spark, sf)
    n = F.count(F.lit(1)).alias("n")

    def section(name, frame, item, count=n, top=None):
        grouped = frame.groupBy(item.alias("item")).agg(count)
        grouped = grouped if top is None else grouped.orderBy(F.desc("n"), "item").limit(top)
        return grouped.select(F.lit(name).alias("section"), "item", "n")

    pages = A.table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("entity")).where("entity <> ''")
    parts = [
        section("overview", rows, F.lit("messages")), section("overview", rows, F.lit("senders"), F.count_distinct("sender_email").alias("n")), section("sender", rows, F.col("sender_email"), top=15),
        section("folder", rows, F.col("category")), section("month", rows, F.date_format("date", "yyyy-MM")), section("entity", pages, F.col("entity"), F.count_distinct("page_id").alias("n"), 20),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(f"""WITH t AS (SELECT * FROM {A.TURNS}), h AS (SELECT conversation_id, count(*) AS thread_messages, string_agg(DISTINCT sender, ',' ORDER BY sender) AS participants FROM t GROUP BY 1), s AS (SELECT sender, count(*) AS sender_messages, round(avg(length(body)), 2) AS sender_chars FROM t GROUP BY 1)
    SELECT t.uid, thread_messages, participants, sender_messages, sender_chars, coalesce(e.n, 0) AS evidence FROM t JOIN h USING (conversation_id) JOIN s USING (sender) LEFT JOIN (SELECT item_id, count(*) AS n FROM benchmark GROUP BY 1) e ON e.item_id = t.conversation_id""")
def deep_context(spark, sf):
    """A message with its thread, its sender's profile and its evidence."""
    turns = A.turns(spark, sf)
    threads = turns.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("thread_messages"), F.array_join(F.array_sort(F.collect_set("sender")), ",").alias("participants"))
    senders = turns.groupBy("sender").agg(F.count(F.lit(1)).alias("sender_messages"), F.round(F.avg(F.length("body")), 2).alias("sender_chars"))
    evidence = A.table(spark, sf, "benchmark").groupBy(F.col("item_id").alias("conversation_id")).agg(F.count(F.lit(1)).alias("evidence"))
    full = turns.join(threads, "conversation_id").join(senders, "sender").join(evidence, "conversation_id", "left")
    return full.select("uid", "thread_messages", "participants", "sender_messages", "sender_chars", F.coalesce("evidence", F.lit(0)).alias("evidence"))


@query("""SELECT 'messages' AS counter, count(*) AS n FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'documents_without_language', count(*) FROM documents WHERE lang IS NULL
    UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'vector_sizes', count(DISTINCT len(embedding)) FROM embeddings UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'evidence', count(*) FROM benchmark UNION ALL SELECT 'labels', count(*) FROM labels""")
def diagnostics_bundle(spark, sf):
    counters = {
        "messages": ("events", F.count(F.lit(1))), "documents": ("documents", F.count(F.lit(1))), "documents_without_language": ("documents", F.count_if(F.col("lang").isNull())), "vectors": ("embeddings", F.count(F.lit(1))),
        "vector_sizes": ("embeddings", F.count_distinct(F.size("embedding"))), "pages": ("pages", F.count(F.lit(1))), "evidence": ("benchmark", F.count(F.lit(1))), "labels": ("labels", F.count(F.lit(1))),
    }
    out = None
    for name, (source, amount) in counters.items():
        part = A.table(spark, sf, source).agg(amount.alias("n")).select(F.lit(name).alias("counter"), "n")
        out = part if out is None else out.unionByName(part)
    return out
