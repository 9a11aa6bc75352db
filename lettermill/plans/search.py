"""Retrieval queries: nearest vectors, keywords, fusion, hybrid search, near duplicates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import archive as A
from ..operators import late, postings, retrieval, similarity
from ..operators.staging import shared_dir, stage
from ..sources import vector_store
from .registry import query

_DOT = "list_dot_product({0}.embedding::DOUBLE[], {1}.embedding::DOUBLE[])"
_NEAR = f"round(greatest(0, least(2, 1 - {_DOT.format('q', 'e')} / sqrt({_DOT.format('q', 'q')}) / sqrt({_DOT.format('e', 'e')}))), 4)"


def _query_vectors(spark, sf):
    rows = A.table(spark, sf, "embeddings")
    return rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query")).select(F.col("label").alias("query_id"), "query")


@query(f"""SELECT query_id, place, vec_id, distance FROM (SELECT q.label AS query_id, e.vec_id, {_NEAR} AS distance, row_number() OVER (PARTITION BY q.label ORDER BY {_NEAR}, e.vec_id)::INT AS place
    FROM (SELECT label, min_by(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) q, embeddings e) WHERE place <= 10""")
def knn_exact(spark, sf):
    """The ten nearest of every label's first vector."""
    found = retrieval.nearest(_query_vectors(spark, sf), A.table(spark, sf, "embeddings").select("vec_id", "embedding"), 10, decimals=4)
    return found.select("query_id", "place", "vec_id", "distance")


@query(f"""SELECT query_id, place, vec_id, distance FROM (SELECT q.label AS query_id, e.vec_id, {_NEAR} AS distance, row_number() OVER (PARTITION BY q.label ORDER BY {_NEAR}, e.vec_id)::INT AS place
    FROM (SELECT label, min_by(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) q JOIN embeddings e ON e.label <> 0) WHERE place <= 5""")
def knn_filtered(spark, sf):
    """Filtered before the limit, so a filter never costs results."""
    vectors = A.table(spark, sf, "embeddings").where("label <> 0").select("vec_id", "embedding")
    return retrieval.nearest(_query_vectors(spark, sf), vectors, 5, decimals=4).select("query_id", "place", "vec_id", "distance")


def _tokens_of(vector):
    """A vector of 64 as eight token vectors of 8."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(vector, i * 8 + 1, F.lit(8)))


_SLICED = "list_transform(range(8), lambda i: {0}.embedding[i * 8 + 1:i * 8 + 8]::DOUBLE[])"


@query(f"""WITH q AS (SELECT label, min_by(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1),
    c AS (SELECT q.label AS query_id, e.vec_id, {_SLICED.format('q')} AS qt, {_SLICED.format('e')} AS dt, row_number() OVER (PARTITION BY q.label ORDER BY {_NEAR}, e.vec_id) AS before FROM q, embeddings e),
    s AS (SELECT query_id, vec_id, before, round(list_sum(list_transform(qt, lambda a: list_max(list_transform(dt, lambda b: list_dot_product(a, b))))), 6) AS score FROM c WHERE before <= 40)
    SELECT query_id, vec_id, round(score, 4) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before)::INT AS place FROM s) WHERE place <= 10""")
def late_interaction(spark, sf):
    """The 40 nearest of every label's first vector, reranked by the best matches of their parts."""
    rows = A.table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = stage(_query_vectors(spark, sf), "late-asked")
    near = retrieval.nearest(asked, rows, 40, decimals=4).select("query_id", F.col("vec_id").alias("doc_id"), "place")
    found = late.maxsim(asked.select("query_id", _tokens_of(F.col("query")).alias("vectors")), near, rows.select(F.col("vec_id").alias("doc_id"), _tokens_of(F.col("embedding")).alias("vectors")), 8, 10)
    return found.select("query_id", F.col("doc_id").alias("vec_id"), F.round("score", 4).alias("score"), "place")


@query()
def late_interaction_codes(spark, sf):
    """The ten best of all vectors by late interaction, found through product-quantised codes; recall is measured in the tests."""
    documents = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), _tokens_of(F.col("embedding")).alias("vectors"))
    asked = stage(_query_vectors(spark, sf).select("query_id", _tokens_of(F.col("query")).alias("vectors")), "late-asked")
    books = late.learn(documents, 8, 4)
    return late.search(asked, documents, stage(late.codes(documents, books), "late-codes"), books, 10)


def _stored(spark, sf, folded):
    """A store of all vectors in two commits, with a checkpoint between them if ``folded``; vectors of label 0 are deleted at the end."""
    vector_store.register(spark)
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    rows = A.table(spark, sf, "embeddings").select("vec_id", "embedding", F.lit(False).alias("deleted"), "label")
    for step, part in enumerate((rows.where("label < 5"), rows.where("label >= 5 or label is null"), rows.where("label = 0").withColumn("deleted", F.lit(True)))):
        part.select("vec_id", "embedding", "deleted").write.format("vector_store").option("path", path).mode("append").save()
        if folded and step == 0:
            vector_store.checkpoint(spark, path)
    return path


@query("SELECT vec_id, len(embedding) AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS squares FROM embeddings WHERE label IS NULL OR label <> 0")
def vector_store_rows(spark, sf):
    """What a store holds after commits, a checkpoint between them, and deletions."""
    held = vector_store.vectors(spark, _stored(spark, sf, True))
    return held.select("vec_id", F.size("embedding").cast("long").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("squares"))


@query()
def knn_stored(spark, sf):
    """The ten nearest of every label's first vector through the stored index and its journal; recall is measured in the tests."""
    return vector_store.search(_query_vectors(spark, sf), _stored(spark, sf, True), 10).select("query_id", "place", "vec_id", F.round("distance", 4).alias("distance"))


@query(f"""SELECT vec_id, distance FROM (SELECT q.vec_id AS vec_id, {_NEAR} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_NEAR}, e.vec_id) AS r
    FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id) WHERE r = 1""")
def find_similar(spark, sf):
    """Every vector's nearest other vector."""
    rows = A.table(spark, sf, "embeddings").select("vec_id", "embedding")
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = retrieval.nearest(queries, rows, 2).where("query_id <> vec_id")
    return found.groupBy(F.col("query_id").alias("vec_id")).agg(F.round(F.min("distance"), 4).alias("distance"))


def _questions(spark, sf):
    return A.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_TOKENS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_\p{{M}}]+'))"


_POLICY = r"""SELECT item_id, CASE WHEN lexical THEN 0.3 WHEN semantic THEN 0.7 ELSE 0.6 END::DOUBLE AS dense_weight, CASE WHEN lexical THEN 0.7 WHEN semantic THEN 0.3 ELSE 0.4 END::DOUBLE AS keyword_weight FROM (
    SELECT item_id, regexp_matches(text, '"[^"\n]+"|''[^''\n]+''') OR regexp_matches(text, '\b\d{6,}\b') AS lexical, contains(text, '?') OR len(regexp_split_to_array(trim(text), '\s+')) >= 8
        OR regexp_matches(text, '(?i)^\s*(?:who|what|when|where|why|how|which|can|could|does|do|is|are|was|were)\b') AS semantic FROM benchmark)"""

_ALL_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_\p{M}]+')"
_CELL = "('0x' || left(md5(t), 8))::BIGINT % 256"
_PLAIN = "replace(replace(replace(replace(x, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
_COMPOUND = " ".join(f"WHEN x = '{word}' THEN {list(parts)!r}" for word, parts in retrieval.COMPOUNDS.items())
_STEM = " ".join(f"WHEN ends_with(x, '{end}') AND length(x) > {len(end) + 4} THEN [left(x, length(x) - {len(end)})]" for end in retrieval.SUFFIXES)
#: Distinct tokens with their variants, of a list of tokens.
_VARIANTS = f"list_distinct(flatten(list_transform({{0}}, lambda x: [x] || CASE WHEN {_PLAIN} <> x THEN [{_PLAIN}] ELSE [] END || CASE {_COMPOUND} ELSE [] END || CASE {_STEM} ELSE [] END)))"

_BM25 = r"""WITH d AS (SELECT doc_id, t, len(t) AS l FROM (SELECT doc_id, {0} AS t FROM documents)),
    s AS (SELECT count(*) AS n, avg(l) AS m FROM d), p AS (SELECT doc_id, l, unnest(t) AS term FROM d),
    i AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, s GROUP BY term, n),
    w AS (SELECT term, CASE WHEN idf < 0 THEN (SELECT avg(idf) * 0.25 FROM i) ELSE idf END AS idf FROM i),
    q AS (SELECT item_id AS query_id, unnest({0}) AS term FROM benchmark),
    r AS (SELECT query_id, doc_id, round(sum(w.idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * p.l / s.m))), 6) AS score FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY 1, 2)
    SELECT query_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS place FROM r WHERE score > 0) WHERE place <= 10"""


@query(_BM25.replace("{0}", _TOKENS.format("text")).replace("SELECT query_id, score, place FROM (", "SELECT query_id, doc_id, score, place FROM ("))
def bm25_search(spark, sf):
    docs = A.table(spark, sf, "documents").select("doc_id", "text")
    return retrieval.bm25(docs, _questions(spark, sf), "doc_id", "text", 10, morphology=False).select("query_id", "doc_id", "score", "place")


@query(_BM25.replace("{0}", _VARIANTS.format(_TOKENS.format("text"))).replace("SELECT query_id, score, place FROM (", "SELECT query_id, doc_id, score, place FROM ("))
def bm25_morphology(spark, sf):
    docs = A.table(spark, sf, "documents").select("doc_id", "text")
    return retrieval.bm25(docs, _questions(spark, sf), "doc_id", "text", 10).select("query_id", "doc_id", "score", "place")


def _indexed(spark, sf):
    """BM25 hits for every benchmark item from an index of two segments: documents of one language, then all others."""
    docs = A.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("first"), retrieval.tokens(F.col("text")).alias("terms"))
    cells = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(None).cast("double").alias("weight")))
    path = f"{shared_dir(spark)}/bm25-{uuid.uuid4().hex}"
    for part in ("first", "not first"):
        postings.add(path, docs.where(part).select("key", cells.alias("cells")))
    raw = retrieval.tokens(F.col("query"), morphology=False)
    asked = _questions(spark, sf).select("query_id", raw.alias("raw"), F.explode(retrieval.tokens(F.col("query"))).alias("term"))
    return postings.search_bm25(postings.open_index(spark, path), asked.select("query_id", "term", F.array_contains("raw", F.col("term")).alias("raw")), 10)


_RAW = f"list_contains({_TOKENS.format('text')}, term)"
_INDEXED = (
    _BM25.replace("q AS (SELECT item_id AS query_id, unnest({0}) AS term FROM benchmark)", f"q AS (SELECT query_id, term, {_RAW} AS raw FROM (SELECT item_id AS query_id, text, unnest({{0}}) AS term FROM benchmark))")
    .replace("{0}", _VARIANTS.format(_TOKENS.format("text")))
    .replace("6) AS score FROM q", "6) AS score, bool_or(q.raw) AS raw FROM q")
    .replace("SELECT query_id, score, place FROM (", "SELECT query_id, doc_id, score, place, raw FROM (")
)


@query(_INDEXED)
def bm25_indexed(spark, sf):
    """The ten best by BM25 from the persisted index, and whether a hit has a word of the query as it stands."""
    return _indexed(spark, sf).hits.select("query_id", F.col("key").alias("doc_id"), "score", "place", "raw")


@query(f"SELECT query_id, count(*) FILTER (raw) AS raw_hit_count, count(*) AS morph_hit_count, count(*) FILTER (NOT raw) AS morph_only_hit_count FROM ({_INDEXED}) GROUP BY 1")
def bm25_hit_counts(spark, sf):
    """How many hits of each query have a word of it as it stands, and how many only a variant."""
    hits = _indexed(spark, sf).hits.groupBy("query_id")
    return hits.agg(F.count(F.when(F.col("raw"), 1)).alias("raw_hit_count"), F.count(F.lit(1)).alias("morph_hit_count"), F.count(F.when(~F.col("raw"), 1)).alias("morph_only_hit_count"))


_SUPPLY = """SELECT doc AS doc, round(sum(w * qw), 6) AS score FROM (SELECT l_orderkey AS doc, l_suppkey AS token, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)
    JOIN (SELECT s_suppkey AS token, s_acctbal AS qw FROM supplier WHERE s_acctbal > 0) USING (token) WHERE w > 0 GROUP BY 1 ORDER BY score DESC, doc LIMIT 50"""


@query(_SUPPLY)
def sparse_indexed(spark, sf):
    """The 50 best order lines for the suppliers' balances, from the persisted index of weights."""
    # dealt by order once, for the sums by supplier and for the lists of orders
    lines = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").cast("string").alias("term"), "l_quantity")
    n = A.parts(spark, sf)
    lines = lines.repartition(*([] if n is None else [n]), "key").groupBy("key", "term").agg(F.sum("l_quantity").cast("double").alias("weight"))
    path = f"{shared_dir(spark)}/sparse-{uuid.uuid4().hex}"
    postings.add(path, lines.groupBy("key").agg(F.collect_list(F.struct("term", "weight")).alias("cells")))
    asked = A.table(spark, sf, "supplier").select(F.lit(1).alias("query_id"), F.col("s_suppkey").cast("string").alias("term"), F.col("s_acctbal").cast("double").alias("factor"))
    return postings.search_dot(postings.open_index(spark, path), asked, 50).hits.select(F.col("key").alias("doc"), "score")


@query(_SUPPLY)
def sparse_dot(spark, sf):
    """Order lines as a sparse vector over suppliers, against the suppliers' balances."""
    weights = A.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("token")).agg(F.sum("l_quantity").alias("weight"))
    asked = A.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("token"), F.col("s_acctbal").alias("query_weight"))
    return retrieval.sparse_dot(weights, asked, "doc", 50)


_RANKED = "SELECT event_id, row_number() OVER (ORDER BY value {0}, event_id) AS place FROM events ORDER BY place LIMIT 100"


@query(f"""WITH d AS ({_RANKED.format('DESC')}), k AS (SELECT event_id, row_number() OVER (ORDER BY user_id, event_id) AS place FROM events ORDER BY place LIMIT 100),
    f AS (SELECT coalesce(d.event_id, k.event_id) AS event_id, d.place AS dp, k.place AS kp, round(coalesce(0.6 / (60 + d.place), 0) + coalesce(0.4 / (60 + k.place), 0), 9) AS score FROM d FULL JOIN k ON d.event_id = k.event_id)
    SELECT event_id, score, row_number() OVER (ORDER BY score DESC, dp NULLS LAST, kp NULLS LAST, event_id)::INT AS place FROM f ORDER BY place LIMIT 50""")
def hybrid_rrf(spark, sf):
    """Two ranked lists of a hundred, fused."""
    from pyspark.sql.window import Window

    rows = A.table(spark, sf, "events")
    dense = rows.orderBy(F.desc("value"), "event_id").limit(100).withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "event_id"))).select("event_id", "place")
    keyword = rows.orderBy("user_id", "event_id").limit(100).withColumn("place", F.row_number().over(Window.orderBy("user_id", "event_id"))).select("event_id", "place")
    return retrieval.fuse(dense, keyword, "event_id", 0.6, 0.4, 50).select("event_id", "score", "place")


_HYBRID = f"""WITH c AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE lang = 'en' GROUP BY text),
    d AS (SELECT doc_id, t, len(t) AS l FROM (SELECT doc_id, {_VARIANTS.format(_TOKENS.format('text'))} AS t FROM c)),
    s AS (SELECT count(*) AS n, avg(l) AS m FROM d), p AS (SELECT doc_id, l, unnest(t) AS term FROM d),
    i AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, s GROUP BY term, n),
    w AS (SELECT term, CASE WHEN idf < 0 THEN (SELECT avg(idf) * 0.25 FROM i) ELSE idf END AS idf FROM i),
    q AS (SELECT item_id AS query_id, unnest({_VARIANTS.format(_TOKENS.format('text'))}) AS term FROM benchmark),
    r AS (SELECT query_id, doc_id, round(sum(w.idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * p.l / s.m))), 6) AS score FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY 1, 2),
    k AS (SELECT query_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM r WHERE score > 0) WHERE place <= 40),
    db AS (SELECT doc_id, cell, count(*)::DOUBLE AS x FROM (SELECT doc_id, {_CELL} AS cell FROM (SELECT doc_id, unnest({_ALL_TOKENS}) AS t FROM c)) GROUP BY 1, 2),
    qb AS (SELECT query_id, cell, count(*)::DOUBLE AS x FROM (SELECT query_id, {_CELL} AS cell FROM (SELECT item_id AS query_id, unnest({_ALL_TOKENS}) AS t FROM benchmark)) GROUP BY 1, 2),
    dn AS (SELECT doc_id, sqrt(sum(x * x)) AS l FROM db GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(x * x)) AS l FROM qb GROUP BY 1),
    e AS (SELECT query_id, doc_id, round(1 - sum(qb.x * db.x) / qn.l / dn.l, 6) AS distance FROM qb JOIN db USING (cell) JOIN qn USING (query_id) JOIN dn USING (doc_id) GROUP BY query_id, doc_id, qn.l, dn.l),
    v AS (SELECT query_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS place FROM e) WHERE place <= 40),
    o AS ({{policy}}),
    f AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.doc_id, k.doc_id) AS doc_id, v.place AS dp, k.place AS kp FROM v FULL JOIN k ON v.query_id = k.query_id AND v.doc_id = k.doc_id),
    g AS (SELECT query_id, doc_id, dp, kp, round(coalesce(dense_weight / (60 + dp), 0) + coalesce(keyword_weight / (60 + kp), 0), 9) AS score FROM f JOIN o ON item_id = query_id)
    SELECT query_id, doc_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dp NULLS LAST, kp NULLS LAST, doc_id)::INT AS place FROM g) WHERE place <= 10"""


@query(_HYBRID.replace("{policy}", _POLICY))
def hybrid_search_filtered(spark, sf):
    """For every benchmark item: the 40 nearest texts by vector and the 40 best by BM25, each over all English texts, one of each text, fused by the query's policy."""
    docs = stage(A.table(spark, sf, "documents").where("lang = 'en'").groupBy(F.sha2("text", 256).alias("h")).agg(F.min(F.struct("doc_id", "text")).alias("d")).select("d.doc_id", "d.text"), "hybrid-documents")
    asked = _questions(spark, sf)
    keyword = retrieval.bm25(docs, asked, "doc_id", "text", 40)
    queries = retrieval.encode_bags(asked, "query_id", "query").select("query_id", F.col("embedding").alias("query"))
    vectors = retrieval.encode_bags(docs, "doc_id", "text").withColumnRenamed("doc_id", "vec_id")
    dense = retrieval.nearest(queries, vectors, 40, decimals=6).withColumnRenamed("vec_id", "doc_id")
    weights = asked.select("query_id", *(w.alias(n) for w, n in zip(retrieval.policy_columns(F.col("query")), ("dense_weight", "keyword_weight"), strict=True)))
    dense, keyword = dense.join(weights, "query_id"), keyword.join(weights, "query_id")
    return retrieval.fuse(dense, keyword, "doc_id", "dense_weight", "keyword_weight", 10, by=("query_id",)).select("query_id", "doc_id", "score", "place")


@query("""SELECT conv_id, turn, round(least(0.99, 0.35 + CASE WHEN contains(lower(text), 'the and') THEN 0.4 ELSE 0 END + 0.2 * ((CASE WHEN contains(lower(text), 'and') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) / 2)), 4)::DOUBLE AS score
    FROM conversations WHERE contains(lower(text), 'and') OR contains(lower(text), 'the')""")
def segment_search(spark, sf):
    body = F.lower("text")
    rows = A.table(spark, sf, "conversations").where(F.contains(body, F.lit("and")) | F.contains(body, F.lit("the")))
    return rows.select("conv_id", "turn", retrieval.segment_score(F.col("text"), "the and").alias("score"))


@query(_POLICY)
def query_policy(spark, sf):
    dense, keyword = retrieval.policy_columns(F.col("text"))
    return A.table(spark, sf, "benchmark").select("item_id", dense.alias("dense_weight"), keyword.alias("keyword_weight"))


@query("""SELECT event_id, round(value / 1000 + CASE WHEN event_type = 'click' THEN 0.03 ELSE -0.02 END + CASE WHEN event_type IN ('click', 'view') THEN 0.015 ELSE 0 END + CASE WHEN event_type = 'purchase' THEN 0.01 ELSE 0 END
    + CASE WHEN value > 50 THEN 0.012 ELSE 0 END + CASE WHEN event_type = 'error' THEN 0.07 ELSE 0 END, 6) AS score FROM events""")
def competition_score(spark, sf):
    kind = F.col("event_type")
    score = retrieval.competition_score(F.col("value") / 1000, kind == "click", kind.isin("click", "view"), kind == "purchase", F.col("value") > 50, kind == "error")
    return A.table(spark, sf, "events").select("event_id", F.round(score, 6).alias("score"))


_GRAMS = r"""(SELECT doc_id, lang, source, list_sort(list_distinct(CASE WHEN len(c) >= 3 THEN list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]) ELSE [array_to_string(c, '')] END)) AS grams FROM (
    SELECT doc_id, lang, source, string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '') AS c FROM documents WHERE length(trim(text)) > 20))"""
_CLASSES = f"(SELECT *, min(doc_id) OVER (PARTITION BY lang, source, grams) AS class_key FROM {_GRAMS})"


@query(f"""WITH h AS (SELECT *, len(grams) AS n FROM {_CLASSES} WHERE doc_id = class_key), e AS (SELECT doc_id, lang, source, n, unnest(grams) AS gram FROM h),
    p AS (SELECT x.lang, x.source, x.doc_id AS a, y.doc_id AS b, count(*) AS shared, x.n AS n, y.n AS m FROM e x JOIN e y ON x.lang = y.lang AND x.source = y.source AND x.gram = y.gram AND x.doc_id < y.doc_id AND least(x.n, y.n) >= 0.85 * greatest(x.n, y.n) GROUP BY ALL)
    SELECT lang, source, a, b, round(shared / (n + m - shared), 4) AS similarity FROM p WHERE shared / (n + m - shared) >= 0.85""")
def near_duplicates(spark, sf):
    docs = A.table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return similarity.near_pairs(docs, "doc_id", "text", ["lang", "source"], 0.85)


@query(f"SELECT doc_id, class_key FROM {_CLASSES}")
def duplicate_classes(spark, sf):
    """Membership: every body and the first of its group with the same n-grams."""
    docs = A.table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return similarity.body_sets(docs, "doc_id", "text", ["lang", "source"]).select("doc_id", "class_key")
