"""Table functions over bodies, and what is learned from them: terms, topics, clusters, triplets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import archive as A
from ..functions import bodies, text
from ..operators import learning
from ..operators import topics as topic_model
from .registry import query


@query()
def html_to_text(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", bodies.html_to_text_udf()("html").alias("body"))


@query()
def strip_quoted(spark, sf):
    return A.turns(spark, sf).select("uid", bodies.quoted_udf()("body", "email_type").alias("q")).select("uid", "q.text", "q.cut")


@query()
def strip_signature(spark, sf):
    return A.turns(spark, sf).select("uid", bodies.signature_udf()("body").alias("s")).select("uid", "s.text", "s.found")


@query()
def segments(spark, sf):
    rows = A.turns(spark, sf).select("uid", F.explode(bodies.segments_udf()("body")).alias("s"))
    return rows.select("uid", "s.*")


@query()
def reply_context(spark, sf):
    return A.turns(spark, sf).select("uid", bodies.reply_context_udf()("body").alias("c")).select("uid", "c.*")


@query()
def chunks(spark, sf):
    rows = A.table(spark, sf, "documents").select("doc_id", F.explode(bodies.chunks_udf()("text")).alias("c"))
    return rows.select("doc_id", "c.ordinal", "c.start", "c.stop", F.sha2("c.text", 256).alias("text_sha256"))


@query("""SELECT doc_id, i::INT AS ordinal, sha256(substring(text, i * 1300 + 1, 1500)) AS text_sha256 FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (greatest(length(text) - 200, 1) + 1299) // 1300))) AS i FROM documents)""")
def chunks_fixed(spark, sf):
    """Windows of 1 500 characters that overlap by 200, without Python."""
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.length("text") - 200, F.lit(1)) / 1300)).cast("int")
    rows = A.table(spark, sf, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("ordinal"))
    return rows.select("doc_id", "ordinal", F.sha2(F.substring("text", F.col("ordinal") * 1300 + 1, F.lit(1500)), 256).alias("text_sha256"))


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_\p{{M}}]+')"


_TOP_TERMS = rf"""WITH t AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
    d AS (SELECT term, count(*) AS df FROM f GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
    s AS (SELECT doc_id, term, round((1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1), 6) AS weight FROM f JOIN d USING (term), n)
    SELECT doc_id, term, weight FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) <= 5"""


@query(_TOP_TERMS)
def tfidf_top_terms(spark, sf):
    return learning.top_terms(A.table(spark, sf, "documents"), "doc_id", "text", 5)


@query(f"""SELECT source, term, score, documents FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY documents DESC, score DESC, term)::INT AS r FROM (
    SELECT source, term, round(avg(weight), 4) AS score, count(DISTINCT doc_id) AS documents FROM ({_TOP_TERMS}) JOIN documents USING (doc_id) GROUP BY 1, 2)) WHERE r <= 20""")
def top_keywords(spark, sf):
    """Keywords of each folder: the mean weight over the documents whose top terms have them."""
    terms = learning.top_terms(A.table(spark, sf, "documents"), "doc_id", "text", 5)
    rows = terms.join(A.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    scored = rows.groupBy("source", "term").agg(F.round(F.avg("weight"), 4).alias("score"), F.count_distinct("doc_id").alias("documents"))
    order = Window.partitionBy("source").orderBy(F.desc("documents"), F.desc("score"), "term")
    return scored.withColumn("r", F.row_number().over(order)).where("r <= 20").drop("r")


def _topics(spark, sf):
    data, vocabulary = topic_model.matrix(A.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return data, topic_model.fit(data, vocabulary, 8)


@query()
def topics(spark, sf):
    """What each document has of each of eight topics."""
    data, model = _topics(spark, sf)
    return topic_model.weights(data, "doc_id", model)


@query()
def topic_terms(spark, sf):
    """The ten heaviest terms of each topic."""
    _, model = _topics(spark, sf)
    rows = [(number, label, place, term) for number, label, terms in (model.top(10) if model else []) for place, term in enumerate(terms, 1)]
    return spark.createDataFrame(rows, "topic int, label string, place int, term string")


@query()
def kmeans_clusters(spark, sf):
    return learning.clusters(A.table(spark, sf, "embeddings"), "vec_id", "embedding")


@query()
def training_triplets(spark, sf):
    return learning.triplets(A.turns(spark, sf))


#: Sentences over 10 characters: split where white space follows an end mark and precedes a capital.
_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '([.!?]) (\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 10)"""


@query(rf"""WITH s AS (SELECT doc_id, len(s) AS n, unnest(range(len(s))) AS place, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)),
    t AS (SELECT doc_id, place, n, unnest({_WORDS.format('sentence')}) AS term FROM s), f AS (SELECT doc_id, place, n, term, count(*) AS tf FROM t GROUP BY ALL),
    w AS (SELECT *, (1 + ln(tf)) * (ln((1 + n) / (1 + count(*) OVER (PARTITION BY doc_id, term))) + 1) AS weight FROM f),
    r AS (SELECT doc_id, place, round(sum(weight) / sqrt(sum(weight * weight)) * CASE WHEN place = 0 THEN 1.5 WHEN place = n - 1 THEN 1.3 WHEN place = 1 THEN 1.2 ELSE 1.0 END, 9) AS final FROM w GROUP BY doc_id, place, n),
    p AS (SELECT doc_id, place FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY final DESC, place) <= 3)
    SELECT doc_id, string_agg(sentence, ' ' ORDER BY place) AS summary FROM p JOIN s USING (doc_id, place) GROUP BY 1""")
def extractive_summary(spark, sf):
    return learning.summaries(A.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 3)


@query(f"""SELECT conv_id AS conversation_id, turn, unnest(range(len(s)))::INT AS place, unnest(list_transform(s, lambda x: length(x)))::INT AS chars
    FROM (SELECT conv_id, turn, {_SENTENCES} AS s FROM conversations)""")
def thread_summary_sentences(spark, sf):
    rows = A.turns(spark, sf).select("conversation_id", "turn", F.posexplode(text.sentences(F.col("body"))).alias("place", "sentence"))
    return rows.select("conversation_id", "turn", "place", F.length("sentence").alias("chars"))
