"""Text, JSON, evidence and diagnostics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import archive as A
from ..functions import analysis, text
from ..operators import filters, quotes
from .registry import query

_PREFIX = "RE|AW|FW|WG|SV|VS|Antw|Doorst"
_SUBJECT = "(CASE turn % 4 WHEN 0 THEN 'Re: AW: ' WHEN 1 THEN 'WG: fwd ' WHEN 2 THEN ' re : ' ELSE '' END || left(split_part(body, '.', 1), 40))"


def _subjects(spark, sf):
    start = F.when(F.col("turn") % 4 == 0, "Re: AW: ").when(F.col("turn") % 4 == 1, "WG: fwd ").when(F.col("turn") % 4 == 2, " re : ").otherwise("")
    return A.turns(spark, sf).withColumn("subject", F.concat(start, F.substring(F.split_part("body", F.lit("."), F.lit(1)), 1, 40)))


@query(rf"SELECT uid, trim(regexp_replace(trim({_SUBJECT}), '^(?:(?:{_PREFIX})\s*:\s*)+', '', 'i')) AS base_subject FROM {A.TURNS}")
def base_subject(spark, sf):
    return _subjects(spark, sf).select("uid", text.base_subject(F.col("subject")).alias("base_subject"))


@query(rf"""SELECT uid, CASE WHEN upper(p) IN ('FW', 'WG', 'VS', 'DOORST') THEN 'forward' WHEN p <> '' THEN 'reply' WHEN in_reply_to <> '' THEN 'reply' ELSE 'original' END AS kind
    FROM (SELECT uid, in_reply_to, regexp_extract(trim({_SUBJECT}), '^({_PREFIX})\s*:', 1, 'i') AS p FROM {A.TURNS})""")
def message_type(spark, sf):
    return _subjects(spark, sf).select("uid", text.message_type(F.col("subject"), F.col("in_reply_to")).alias("kind"))


@query(f"SELECT uid, sha256(CASE WHEN turn > 0 THEN uid ELSE concat_ws('|', conversation_id, sender, left(body, 500)) END) AS canonical_uid FROM {A.TURNS}")
def canonical_uid(spark, sf):
    key = F.when(F.col("turn") > 0, F.col("uid"))
    return A.turns(spark, sf).select("uid", text.canonical_uid(key, F.col("conversation_id"), F.col("sender"), F.substring("body", 1, 500)).alias("canonical_uid"))


@query(f"SELECT uid, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS body FROM {A.DOCUMENTS}")
def whitespace_squeeze(spark, sf):
    return A.documents(spark, sf).select("uid", text.squeeze(F.col("body")).alias("body"))


_QUOTE_FORM = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"


_MARKED = "translate(replace({0}, '…', '...'), '“”„«»’‘‚–—−', '" + 5 * '"' + 3 * "''" + "---')"
_FOLDED = "replace(lower({0}), 'ß', 'ss')"
_LETTERS = "regexp_replace({0}, '[^a-z0-9]+', '', 'g')"
_JOINED = r"regexp_replace({0}, '([\p{{L}}\p{{N}}])[-‐‑‒–][ \t]*(?:\r\n|\r|\n)[ \t]*([\p{{L}}\p{{N}}])', '\1\2', 'g')"
_WRITTEN = "replace(replace(replace({0}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')"
#: The three forms of a text: squeezed, its letters and digits, those of the near form.
_FORMS = f"""{_FOLDED.format("trim(regexp_replace(" + _MARKED.format("text") + ", '\\s+', ' ', 'g'))")} AS ws, {_LETTERS.format("ws")} AS letters, {_LETTERS.format(_WRITTEN.format(_FOLDED.format(_JOINED.format(_MARKED.format("text")))))} AS near"""
_MATCHES = f"""SELECT item_id, doc_id, CASE WHEN contains(d.ws, q.ws) OR (length(q.letters) >= 24 AND contains(d.letters, q.letters)) THEN 'exact' ELSE 'near_exact' END AS state
    FROM (SELECT item_id, {_FORMS} FROM benchmark) q JOIN (SELECT doc_id, {_FORMS} FROM documents) d
    ON q.ws <> '' AND (contains(d.ws, q.ws) OR (length(q.letters) >= 24 AND contains(d.letters, q.letters)) OR (length(q.near) >= 24 AND contains(d.near, q.near)))"""


def _quotes(spark, sf):
    return A.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"), A.table(spark, sf, "documents").select(F.col("doc_id").alias("sid"), "text")


@query(_MATCHES)
def quote_match_state(spark, sf):
    """Which quotes occur in which surfaces, by the whole ladder."""
    return quotes.match(*_quotes(spark, sf)).select(F.col("qid").alias("item_id"), F.col("sid").alias("doc_id"), "state")


@query(f"""SELECT count(*) AS total, count(*) FILTER (state = 'exact') AS exact, count(*) FILTER (state = 'near_exact') AS near_exact
    FROM benchmark LEFT JOIN (SELECT item_id, min(state) AS state FROM ({_MATCHES}) GROUP BY 1) USING (item_id)""")
def evidence_verify(spark, sf):
    """How many quotes are found in some surface, exactly or nearly."""
    return quotes.verified(*_quotes(spark, sf))


_GRAMS = "list_distinct(list_transform(range(1, greatest(2, length(c) - 1)), lambda i: c[i:i+2]))"


@query(f"""WITH g AS (SELECT conv_id, turn, {_GRAMS} AS g FROM (SELECT conv_id, turn, {_QUOTE_FORM.format("text")} AS c FROM conversations))
    SELECT a.conv_id, a.turn, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 4) AS similarity
    FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""")
def char_ngram_jaccard(spark, sf):
    grams = A.table(spark, sf, "conversations").select("conv_id", "turn", text.char_ngrams(F.col("text")).alias("g"))
    before = grams.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("g").alias("h"))
    return grams.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.jaccard(F.col("g"), F.col("h")), 4).alias("similarity"))


# entities


def _entities(spark, sf, kind):
    rows = A.documents(spark, sf).select("uid", "body").union(A.table(spark, sf, "pages").select(F.concat(F.lit("page"), "page_id"), "html"))
    return analysis.entities(rows, "uid", "body", (kind,)).select("uid", "entity")


_BODIES = "(SELECT CAST(doc_id AS VARCHAR) AS uid, text AS body FROM documents UNION ALL SELECT 'page' || page_id, html FROM pages)"


@query(rf"SELECT DISTINCT uid, unnest(list_transform(regexp_extract_all(body, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}'), lambda e: lower(e))) AS entity FROM {_BODIES}")
def regex_entities_email(spark, sf):
    return _entities(spark, sf, "email")


@query(rf"SELECT DISTINCT uid, unnest(list_transform(regexp_extract_all(body, '@[a-zA-Z]\w{{1,30}}'), lambda e: lower(e))) AS entity FROM {_BODIES}")
def regex_entities_mention(spark, sf):
    return _entities(spark, sf, "mention")


@query(rf"""SELECT DISTINCT uid, regexp_replace(p, '\D', '', 'g') AS entity FROM (
        SELECT uid, trim(unnest(regexp_extract_all(body, '(?:\+\d{{1,3}}[ \t.-]?)?(?:\(?\d{{2,5}}\)?[ \t.-]?)?\d[\d \t.\-/]{{5,16}}\d'))) AS p FROM {_BODIES})
    WHERE NOT regexp_matches(p, '^\d{{1,4}}[/\-.]\d{{1,2}}[/\-.]\d{{1,4}}$') AND NOT regexp_matches(p, '^\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}$') AND length(regexp_replace(p, '\D', '', 'g')) >= 7""")
def regex_entities_phone(spark, sf):
    return _entities(spark, sf, "phone")


@query(r"""WITH t AS (SELECT page_id, html || ' see (' || url || ').' AS body FROM pages), u AS (SELECT page_id, regexp_replace(unnest(regexp_extract_all(body, '(?i)https?://[^\s<>"''\]]+')), '[.,;:!?]+$', '') AS u FROM t),
    c AS (SELECT page_id, u, greatest(0, len(regexp_extract_all(u, '\)')) - len(regexp_extract_all(u, '\('))) AS surplus, length(regexp_extract(u, '(\)*)$', 1)) AS closing FROM u)
    SELECT DISTINCT page_id, lower(left(u, length(u) - least(surplus, closing))) AS entity FROM c""")
def regex_entities_url(spark, sf):
    """Addresses in the pages, each page with its own address in brackets at its end."""
    rows = A.table(spark, sf, "pages").select("page_id", F.concat("html", F.lit(" see ("), "url", F.lit(").")).alias("body"))
    return analysis.entities(rows, "page_id", "body", ("url",)).select("page_id", "entity")


@query("SELECT url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS domain FROM pages")
def regex_entities_domain(spark, sf):
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    return A.table(spark, sf, "pages").select("url", analysis.organisation(F.concat(F.lit("mail@"), host)).alias("domain"))


@query(rf"""WITH m AS (SELECT DISTINCT uid, unnest(list_transform(regexp_extract_all(body, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}'), lambda e: lower(e))) AS entity FROM {_BODIES})
    SELECT entity, count(*) AS emails, min(uid) AS first_uid FROM m WHERE entity LIKE '%example%' GROUP BY 1""")
def entity_search(spark, sf):
    hits = _entities(spark, sf, "email").where(filters.contains_like(F.col("entity"), "example"))
    return hits.groupBy("entity").agg(F.count(F.lit(1)).alias("emails"), F.min("uid").alias("first_uid"))


@query(rf"""WITH m AS (
        SELECT DISTINCT uid, 'email' AS kind, unnest(list_transform(regexp_extract_all(body, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}'), lambda e: lower(e))) AS entity FROM {_BODIES}
        UNION ALL SELECT DISTINCT uid, 'mention', unnest(list_transform(regexp_extract_all(body, '@[a-zA-Z]\w{{1,30}}'), lambda e: lower(e))) FROM {_BODIES})
    SELECT a.entity, b.entity AS other, count(DISTINCT a.uid) AS emails FROM m a JOIN m b ON a.uid = b.uid AND a.kind = 'email' AND b.kind = 'mention' GROUP BY 1, 2""")
def entity_cooccurrence(spark, sf):
    emails, mentions = _entities(spark, sf, "email"), _entities(spark, sf, "mention").withColumnRenamed("entity", "other")
    return emails.join(mentions, "uid").groupBy("entity", "other").agg(F.count_distinct("uid").alias("emails"))


# analyses

_LIST = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_SENTIMENT = rf"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}+(?:''\p{{L}}+)?') AS w FROM documents),
    s AS (SELECT doc_id, list_transform(w, lambda x, i: (CASE WHEN list_contains({_LIST(analysis.POSITIVE)}, x) THEN 1 WHEN list_contains({_LIST(analysis.NEGATIVE)}, x) THEN -1 ELSE 0 END)
            * (CASE WHEN i > 1 AND list_has_any(w[greatest(1, i - 2):i - 1], {_LIST(analysis.NEGATIONS)}) THEN -1 ELSE 1 END)) AS p FROM t),
    c AS (SELECT doc_id, len(list_filter(p, lambda x: x > 0))::INT AS positive, len(list_filter(p, lambda x: x < 0))::INT AS negative FROM s),
    d AS (SELECT *, CASE WHEN positive + negative = 0 THEN 0 ELSE (positive - negative) / (positive + negative) END::DOUBLE AS v FROM c)
    SELECT doc_id, CASE WHEN v > 0.1 THEN 'positive' WHEN v < -0.1 THEN 'negative' ELSE 'neutral' END AS label, round(v, 4) AS score, positive, negative FROM d"""


@query(_SENTIMENT)
def sentiment(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", analysis.sentiment(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(f"SELECT label, count(*) AS n, round(avg(score), 4) AS mean_score FROM ({_SENTIMENT}) GROUP BY 1")
def sentiment_distribution(spark, sf):
    return sentiment(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


_SHARE = lambda lang: f"CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains({_LIST(analysis.STOP_WORDS[lang])}, x))) / len(w) ELSE 0 END::DOUBLE"


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ]+') AS w FROM documents),
    s AS (SELECT doc_id, len(w) AS tokens, unnest([{", ".join(f"{{'language': '{n}', 'share': round({_SHARE(n)}, 6)}}" for n in sorted(analysis.STOP_WORDS))}]) AS s FROM t),
    r AS (SELECT doc_id, tokens, s.language AS language, s.share AS share, row_number() OVER (PARTITION BY doc_id ORDER BY s.share DESC, s.language) AS r FROM s)
    SELECT doc_id, tokens, CASE WHEN share < 0.02 THEN 'unknown' ELSE language END AS language, share FROM r WHERE r = 1""")
def language_stopword_score(spark, sf):
    return analysis.language_shares(A.table(spark, sf, "documents"), "doc_id", "text")


@query("""SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""")
def language_distribution(spark, sf):
    docs = A.table(spark, sf, "documents")
    return docs.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count(F.lit(1)).alias("n"))


_METRICS = r"""(SELECT doc_id, source, n::INT AS word_count, e::INT AS sentence_count, round(n / e + 1e-9, 2) AS avg_sentence_length, round(list_sum(list_transform(w, lambda x: length(x))) / n + 1e-9, 2) AS avg_word_length,
        round(len(list_distinct(w)) / n + 1e-9, 4) AS vocabulary_richness, round((length(body) - length(replace(body, '?', ''))) / e + 1e-9, 4) AS question_frequency,
        round((length(body) - length(replace(body, '!', ''))) / e + 1e-9, 4) AS exclamation_frequency, round(len(list_filter(w, lambda x: length(x) > 6)) / n + 1e-9, 4) AS formality_score
    FROM (SELECT *, len(w) AS n, greatest(1, len(list_filter(regexp_split_to_array(regexp_replace(trim(body), '\.{2,}', chr(1), 'g'), '\.\s+|[!?]+\s+|\.$|[!?]+$'), lambda x: trim(x) <> ''))) AS e
        FROM (SELECT doc_id, source, coalesce(text, '') AS body, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+(?:[''’-]\p{L}+)*') AS w FROM documents))
    WHERE length(trim(body)) >= 20 AND n >= 5)"""


@query(f"SELECT * EXCLUDE (source) FROM {_METRICS}")
def writing_metrics(spark, sf):
    return analysis.measured(A.table(spark, sf, "documents"), "doc_id", "text")


@query(f"""SELECT source AS folder, count(*) AS emails_analyzed, round(avg(avg_sentence_length) + 1e-9, 2) AS avg_sentence_length, round(avg(avg_word_length) + 1e-9, 2) AS avg_word_length,
    round(avg(vocabulary_richness) + 1e-9, 4) AS avg_vocabulary_richness, round(avg(formality_score) + 1e-9, 4) AS avg_formality, sum(word_count)::BIGINT AS total_words FROM {_METRICS} GROUP BY 1""")
def sender_profile(spark, sf):
    """Means of the metrics of each sender's texts."""
    rows = analysis.measured(A.documents(spark, sf), "folder", "body")
    return rows.groupBy("folder").agg(
        F.count(F.lit(1)).alias("emails_analyzed"), F.round(F.avg("avg_sentence_length"), 2).alias("avg_sentence_length"), F.round(F.avg("avg_word_length"), 2).alias("avg_word_length"),
        F.round(F.avg("vocabulary_richness"), 4).alias("avg_vocabulary_richness"), F.round(F.avg("formality_score"), 4).alias("avg_formality"), F.sum("word_count").alias("total_words"),
    )


@query(rf"""WITH e AS (SELECT doc_id, len(regexp_extract_all(text, '{text.EMAIL}')) AS n, regexp_replace(text, '{text.EMAIL}', '[REDACTED: email]', 'g') AS body FROM documents)
    SELECT doc_id, (n + len(regexp_extract_all(body, '{text.PHONE}')))::INT AS hidden, sha256(regexp_replace(body, '{text.PHONE}', '[REDACTED: phone]', 'g')) AS redacted_sha256 FROM e""")
def privacy_redaction(spark, sf):
    body, hidden = text.redact(F.col("text"), "contact_redacted")
    return A.table(spark, sf, "documents").select("doc_id", hidden.alias("hidden"), F.sha2(body, 256).alias("redacted_sha256"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN '''' || text ELSE text END AS cell FROM documents")
def csv_safe_cell(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", text.csv_safe(F.col("text")).alias("cell"))


_NOTED = f"""(SELECT CAST(doc_id AS VARCHAR) AS uid, text AS body FROM documents UNION ALL SELECT uid, body FROM {A.TURNS}
    UNION ALL SELECT 'item' || item_id, 'Please review ' || left(text, 40) || '. We decided to ' || left(text, 30) || '! Termin heute, bitte um Rückmeldung; URGENT deadline: ' || left(text, 20) FROM benchmark)"""
_QUOTED = lambda pattern: "'" + pattern.replace("'", "''") + "'"
_CLAUSES = lambda starts: f"""(SELECT DISTINCT uid, lower(trim(c)) AS clause FROM (SELECT uid, unnest({" || ".join(f"regexp_extract_all(body, {_QUOTED('(?i)' + x + analysis.CLAUSE)}, 1)" for x in starts)}) AS c FROM {_NOTED}) WHERE length(trim(c)) >= 5)"""


def _noted(spark, sf):
    """Documents, turns, and the benchmark's items as notes that ask and decide."""
    item = F.concat(F.lit("Please review "), F.left("text", F.lit(40)), F.lit(". We decided to "), F.left("text", F.lit(30)), F.lit("! Termin heute, bitte um Rückmeldung; URGENT deadline: "), F.left("text", F.lit(20)))
    notes = A.table(spark, sf, "benchmark").select(F.concat(F.lit("item"), "item_id").alias("uid"), item.alias("body"))
    return A.documents(spark, sf).select("uid", "body").union(A.turns(spark, sf).select("uid", "body")).union(notes)


@query(" UNION ALL ".join(rf"""SELECT uid, '{kind}' AS event_kind, trigger, sha256(uid || '|{kind}|' || lower(trigger)) AS event_key
    FROM (SELECT DISTINCT uid, trim(regexp_replace(unnest(regexp_extract_all(body, {_QUOTED(pattern)})), '\s+', ' ', 'g')) AS trigger FROM {_NOTED})""" for kind, pattern in analysis.EVENT_RULES))
def event_rules(spark, sf):
    return analysis.event_hits(_noted(spark, sf), "uid", "body")


@query(f"SELECT uid, clause, {' OR '.join(f'contains(clause, {_QUOTED(w)})' for w in analysis.URGENT)} AS urgent FROM {_CLAUSES(analysis.ACTION_STARTS)}")
def action_items(spark, sf):
    return analysis.clauses(_noted(spark, sf), "uid", "body", analysis.ACTION_STARTS).withColumn("urgent", analysis.urgency(F.col("clause")))


@query(f"SELECT uid, clause FROM {_CLAUSES(analysis.DECISION_STARTS)}")
def decisions(spark, sf):
    return analysis.clauses(_noted(spark, sf), "uid", "body", analysis.DECISION_STARTS)


# JSON


@query("""SELECT event_id, event_type FROM events WHERE (CAST(json_extract(props, '$.k') AS BIGINT) IN (1, 2, 3) OR CAST(json_extract(props, '$.k') AS BIGINT) > 50)
    AND CAST(json_extract(props, '$.k') AS BIGINT) <> 77""")
def metadata_predicates(spark, sf):
    where = {"$and": [{"$or": [{"k": {"$in": [1, 2, 3]}}, {"k": {"$gt": 50}}]}, {"k": {"$ne": 77}}]}
    return filters.metadata_filter(A.table(spark, sf, "events"), "props", where).select("event_id", "event_type")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS largest FROM events GROUP BY 1")
def json_path_agg(spark, sf):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return A.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.max(k).alias("largest"))


# diagnostics and evidence


@query("""SELECT count(*) AS total, count(*) FILTER (text IS NULL OR text = '') AS empty_bodies, count(*) FILTER (lang IS NULL) AS no_language, count(*) FILTER (length(text) < 20) AS short_bodies,
    count(*) FILTER (contains(text, '@')) AS with_address, count(DISTINCT source) AS folders FROM documents""")
def content_diagnostics(spark, sf):
    body = F.col("text")
    return A.table(spark, sf, "documents").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(body.isNull() | (body == "")).alias("empty_bodies"), F.count_if(F.col("lang").isNull()).alias("no_language"), F.count_if(F.length(body) < 20).alias("short_bodies"),
        F.count_if(F.contains(body, F.lit("@"))).alias("with_address"), F.count_distinct("source").alias("folders"),
    )


@query("""SELECT lang, count(*) AS n, round(count(*) FILTER (length(text) >= 20) / count(*), 4) AS usable, round(count(l.doc_id) / count(*), 4) AS labelled
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def qa_readiness(spark, sf):
    labels = A.table(spark, sf, "labels").select(F.col("doc_id").alias("labelled"))
    docs = A.table(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("chars"))
    rows = docs.join(labels, docs["doc_id"] == labels["labelled"], "left")
    rate = lambda x: F.round(F.try_divide(x, F.count(F.lit(1))), 4)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), rate(F.count_if(F.col("chars") >= 20)).alias("usable"), rate(F.count("labelled")).alias("labelled"))


@query("""SELECT quality, toxic, count(*) AS n FROM labels GROUP BY GROUPING SETS ((quality), (toxic), ())""")
def evidence_stats(spark, sf):
    return A.table(spark, sf, "labels").groupingSets([["quality"], ["toxic"], []], "quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(s.category, c.category) AS category, coalesce(c.n, 0) AS n, s.category IS NOT NULL AS suggested
    FROM (VALUES ('en'), ('de'), ('it')) s(category) FULL JOIN (SELECT lang AS category, count(*) AS n FROM documents GROUP BY 1) c ON c.category = s.category""")
def evidence_categories(spark, sf):
    suggested = spark.createDataFrame([("en",), ("de",), ("it",)], "suggested_name string")
    counts = A.table(spark, sf, "documents").groupBy(F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    both = F.broadcast(suggested).join(counts, F.col("suggested_name") == F.col("category"), "full")
    return both.select(F.coalesce("suggested_name", "category").alias("category"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("suggested_name").isNotNull().alias("suggested"))


@query(f"SELECT uid, date, category, value FROM {A.MESSAGES} WHERE category = 'error' ORDER BY date, uid LIMIT 100 OFFSET 5")
def evidence_timeline(spark, sf):
    return A.messages(spark, sf).where("category = 'error'").select("uid", "date", "category", "value").orderBy("date", "uid").offset(5).limit(100)


@query("SELECT doc_id, lang FROM documents WHERE text ILIKE '%password=%' OR text ILIKE '%all rights\\_%' ESCAPE '\\' OR text ILIKE '%all rights%'")
def search_evidence(spark, sf):
    body = F.col("text")
    test = filters.contains_like(body, "password=") | filters.contains_like(body, "all rights_") | filters.contains_like(body, "ALL RIGHTS")
    return A.table(spark, sf, "documents").where(test).select("doc_id", "lang")


@query(f"SELECT uid, category AS action, sha256(concat_ws('|', uid, category, props)) AS content_hash, date FROM {A.MESSAGES} WHERE sender_email = 'user7@example.com' ORDER BY date DESC, uid LIMIT 100")
def custody_chain(spark, sf):
    rows = A.messages(spark, sf).where("sender_email = 'user7@example.com'")
    return rows.select("uid", F.col("category").alias("action"), F.sha2(F.concat_ws("|", "uid", "category", "props"), 256).alias("content_hash"), "date").orderBy(F.desc("date"), "uid").limit(100)
