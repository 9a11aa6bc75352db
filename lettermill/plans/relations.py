"""Joins, contacts, graph queries and attachments."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import archive as A
from ..operators import contacts, louvain, filters
from .registry import query


@query(f"""SELECT r.uid, o.uid AS original_uid, r.sender AS replier, o.sender AS original_sender
    FROM {A.TURNS} r JOIN {A.TURNS} o ON r.in_reply_to = o.uid WHERE r.in_reply_to <> ''""")
def response_pairs(spark, sf):
    turns = A.turns(spark, sf)
    original = turns.select(F.col("uid").alias("original_uid"), F.col("sender").alias("original_sender"))
    return turns.where("in_reply_to <> ''").join(original, F.col("in_reply_to") == F.col("original_uid")).select("uid", "original_uid", F.col("sender").alias("replier"), "original_sender")


@query(f"""SELECT recipient, count(DISTINCT sender) AS sender_count, count(*) AS total_emails FROM {A.LETTERS}
    WHERE sender IN (SELECT 'customer' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1 HAVING count(DISTINCT sender) >= 2""")
def shared_recipients(spark, sf):
    senders = A.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer"), "c_custkey").alias("sender"))
    return contacts.shared_recipients(A.letters(spark, sf), senders, 2)


@query(f"SELECT sender, recipient, email_count, first_seen, last_seen FROM {A.EDGES}")
def communication_edges(spark, sf):
    return A.edges(spark, sf)


@query(f"""SELECT email, min(date) AS first_seen, max(date) AS last_seen, sum(sent)::BIGINT AS sent_count, sum(1 - sent)::BIGINT AS received_count
    FROM (SELECT sender AS email, date, 1 AS sent FROM {A.LETTERS} UNION ALL SELECT recipient, date, 0 FROM {A.LETTERS}) GROUP BY 1""")
def contacts_upsert(spark, sf):
    return contacts.upsert_contacts(A.letters(spark, sf))


@query(f"""SELECT partner, sum(email_count)::BIGINT AS total FROM (
        SELECT recipient AS partner, email_count FROM {A.EDGES} WHERE sender = 'supplier7'
        UNION ALL SELECT sender, email_count FROM {A.EDGES} WHERE recipient = 'supplier7')
    GROUP BY 1 ORDER BY total DESC, partner LIMIT 20""")
def top_contacts(spark, sf):
    return contacts.top_contacts(A.edges(spark, sf), "supplier7", 20)


@query(f"""SELECT coalesce(sum(email_count) FILTER (sender = 'customer7'), 0)::BIGINT AS a_to_b, coalesce(sum(email_count) FILTER (sender = 'supplier7'), 0)::BIGINT AS b_to_a,
        min(first_seen) AS first_seen, max(last_seen) AS last_seen
    FROM {A.EDGES} WHERE (sender = 'customer7' AND recipient = 'supplier7') OR (sender = 'supplier7' AND recipient = 'customer7')""")
def communication_between(spark, sf):
    return contacts.communication_between(A.edges(spark, sf), "customer7", "supplier7")


@query("""SELECT c_name, CASE WHEN domain = 'gmail.com' THEN replace(split_part(local, '+', 1), '.', '') ELSE local END || '@' || domain AS identity FROM (
        SELECT c_name, lower(replace(c_name, '#', '.')) || '+' || c_nationkey AS local, CASE WHEN c_acctbal > 0 THEN 'gmail.com' ELSE 'mail.example.com' END AS domain FROM customer)""")
def contact_identity(spark, sf):
    domain = F.when(F.col("c_acctbal") > 0, "GoogleMail.com").otherwise("mail.example.com")
    address = F.concat(F.regexp_replace("c_name", "#", "."), F.lit("+"), F.col("c_nationkey"), F.lit("@"), domain)
    return A.table(spark, sf, "customer").select("c_name", contacts.contact_identity(address).alias("identity"))


# attachments


@query(f"""SELECT uid, name, size, mime_type, sender FROM {A.ATTACHMENTS}
    WHERE name ILIKE '%WI%' AND lower(name) LIKE '%.promo' ORDER BY size DESC, uid, line LIMIT 50 OFFSET 10""")
def attachments_browse(spark, sf):
    rows = A.attachments(spark, sf).where(filters.contains_like(F.col("name"), "WI") & F.lower("name").endswith(".promo"))
    return rows.orderBy(F.desc("size"), "uid", "line").offset(10).limit(50).select("uid", "name", "size", "mime_type", "sender")


@query(f"""SELECT uid, string_agg(name, ', ' ORDER BY name) AS names, count(*) AS n FROM {A.ATTACHMENTS} WHERE mime_type ILIKE '%econ%' GROUP BY 1""")
def emails_by_attachment(spark, sf):
    rows = A.attachments(spark, sf).where(filters.contains_like(F.col("mime_type"), "econ"))
    return rows.groupBy("uid").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT regexp_extract(name, '(\\.[^.]*)$', 1) AS extension, count(*) AS n, count(DISTINCT uid) AS owners, sum(size)::BIGINT AS bytes FROM {A.ATTACHMENTS} GROUP BY 1")
def attachment_stats(spark, sf):
    extension = F.regexp_extract("name", r"(?<=.)(\.[^.]*)$", 1)
    # by letter first: these rows lie together already, and few are left of each extension
    each = A.attachments(spark, sf).groupBy(extension.alias("extension"), "uid").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return each.groupBy("extension").agg(F.sum("n").alias("n"), F.count("uid").alias("owners"), F.sum("bytes").alias("bytes"))


# clusters and topics

_COSINE = "round(list_cosine_similarity(e.embedding, c.embedding), 4)"


@query("""WITH c AS (SELECT label, min(vec_id) AS head FROM embeddings GROUP BY 1)
    SELECT c.label, count(e.vec_id) AS members, c.head AS representative FROM c LEFT JOIN embeddings e ON e.label = c.label GROUP BY 1, 3""")
def cluster_summary(spark, sf):
    rows = A.table(spark, sf, "embeddings")
    return rows.groupBy("label").agg(F.count("vec_id").alias("members"), F.min("vec_id").alias("representative"))


@query("""WITH c AS (SELECT label, min_by(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1)
    SELECT e.label, e.vec_id, round(1 - list_dot_product(e.embedding::DOUBLE[], c.embedding::DOUBLE[])
        / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])), 4) + 0 AS distance
    FROM embeddings e JOIN c USING (label)""")
def cluster_members(spark, sf):
    """Members with their distance from the first of the cluster."""
    from ..operators.retrieval import cosine

    rows = A.table(spark, sf, "embeddings")
    heads = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    return rows.join(heads, "label").select("label", "vec_id", (F.round(1 - cosine(F.col("embedding"), F.col("head")), 4) + 0.0).alias("distance"))


@query("""SELECT d.lang, count(l.doc_id) AS labelled, coalesce(sum(l.quality), 0)::BIGINT AS good, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def topic_distribution(spark, sf):
    docs, labels = A.table(spark, sf, "documents").select("doc_id", "lang"), A.table(spark, sf, "labels").select(F.col("doc_id").alias("labelled"), "quality")
    rows = docs.join(labels, docs["doc_id"] == labels["labelled"], "left")
    return rows.groupBy("lang").agg(F.count("labelled").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("good"), F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def orphan_anti_join(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", "p_name").join(A.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE d.text <> '' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality IS NOT NULL)")
def missing_analytics_anti_join(spark, sf):
    done = A.table(spark, sf, "labels").where("quality is not null").select("doc_id")
    return A.table(spark, sf, "documents").where("text <> ''").select("doc_id", "lang").join(done, "doc_id", "left_anti")


# graph

_UNDIRECTED = f"(SELECT least(sender, recipient) AS a, greatest(sender, recipient) AS b, sum(email_count)::BIGINT AS weight FROM {A.EDGES} GROUP BY 1, 2)"


@query(f"SELECT a, b, weight FROM {_UNDIRECTED}")
def undirected_edges(spark, sf):
    return contacts.undirected(A.edges(spark, sf))


@query(f"""WITH d AS (SELECT node, count(*) AS degree FROM (SELECT sender AS node FROM {A.EDGES} UNION ALL SELECT recipient FROM {A.EDGES}) GROUP BY 1)
    SELECT node, degree, round(CASE WHEN n > 1 THEN degree / (n - 1) ELSE 0 END, 4) AS centrality FROM d, (SELECT count(*)::DOUBLE AS n FROM d)""")
def degree_centrality(spark, sf):
    return contacts.degree_centrality(A.edges(spark, sf))


@query(f"""WITH RECURSIVE s AS (SELECT a AS u, b AS v, weight FROM {_UNDIRECTED} UNION ALL SELECT b, a, weight FROM {_UNDIRECTED}),
    p AS (SELECT 'customer1' AS u, ['customer1'] AS nodes, 0 AS hops, 0.0::DOUBLE AS cost
        UNION ALL SELECT s.v, list_append(p.nodes, s.v), p.hops + 1, p.cost + 1.0 / s.weight FROM p JOIN s ON s.u = p.u
        WHERE p.hops < 3 AND NOT list_contains(p.nodes, s.v) AND p.u <> 'supplier3' AND (p.hops < 2 OR s.v = 'supplier3'))
    SELECT array_to_string(nodes, '>') AS path, hops, round(cost, 9) AS cost FROM p WHERE u = 'supplier3' ORDER BY cost, hops, path LIMIT 5""")
def k_paths(spark, sf):
    return contacts.cheapest_paths(A.edges(spark, sf), "customer1", "supplier3", 3, 5)


@query(f"""SELECT email, count(DISTINCT partner) AS partners, sum(sent)::BIGINT AS send_count, sum(received)::BIGINT AS receive_count FROM (
        SELECT sender AS email, recipient AS partner, email_count AS sent, 0 AS received FROM {A.EDGES}
        UNION ALL SELECT recipient, sender, 0, email_count FROM {A.EDGES}) GROUP BY 1""")
def relationship_summary(spark, sf):
    return contacts.relationship_summary(A.edges(spark, sf), A.parts(spark, sf))


@query()
def communities(spark, sf):
    """Louvain communities of correspondents, letters in both directions summed."""
    return louvain.communities(contacts.undirected(A.edges(spark, sf)))


@query()
def betweenness(spark, sf):
    """Of the nations as correspondents: a customer's nation writes to a supplier's."""
    customers = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("nation"), "c_nationkey").alias("sender"))
    suppliers = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("nation"), "s_nationkey").alias("recipient"))
    lines = A.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    edges = lines.join(customers, "o_custkey").join(suppliers, "l_suppkey").groupBy("sender", "recipient").agg(F.count(F.lit(1)).alias("email_count"))
    return contacts.betweenness(edges)


@query(f"""WITH RECURSIVE t AS (SELECT uid, uid AS root FROM {A.TURNS} WHERE in_reply_to IS NULL
        UNION ALL SELECT c.uid, t.root FROM {A.TURNS} c JOIN t ON c.in_reply_to = t.uid)
    SELECT uid, root AS thread_id FROM t""")
def thread_components(spark, sf):
    from ..operators.threads import thread_roots

    return thread_roots(A.turns(spark, sf))
