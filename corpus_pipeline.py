"""The corpus pipeline: five stages over ``documents``, each written and read again by the next.

1. Language ID: documents in which no language can be found go.
2. Exact dedup: of equal texts (white space aside) one stays.
3. N-gram join: of each component of near duplicates one row stays, that of the smallest id.
4. Decontamination: documents that hold a benchmark item go.
5. BPE: the remaining texts as token ids, which decode to the text.

Ids may be null or repeat: a stage drops rows by their id and text, never by the id alone.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of
their input, and each works on all that the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import bpe, decontam, exact_dedup, langid, ngram_join
from lettermill.llm.common import fresh, new_path, row_key, small, stage, table
from lettermill.llm.queries import VOCABULARY


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those that mix several stay, whatever the share of each."""
    model = langid.fit(docs, langid.fold("doc_id", 3) != 1)
    text_hash, bad_hash, bad_id = fresh(docs, "text_hash", "bad_hash", "bad_id")
    marked = docs.withColumn(text_hash, F.xxhash64("text"))
    verdict = langid.predict(marked.withColumn("doc_id", F.struct("doc_id", text_hash)), model)
    rejected = verdict.where(F.col("lang_pred") == langid.UNDETERMINED)
    rejected = small(stage(rejected.select(F.col("doc_id.doc_id").alias(bad_id), F.col(f"doc_id.{text_hash}").alias(bad_hash)).distinct(), "pipeline-rejected"))
    kept = marked.join(rejected, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.col(text_hash) == F.col(bad_hash)), "left_anti")
    return kept.select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, leaked = fresh(docs, "row_key", "leaked_key")
    marked = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    found = small(stage(decontam.find(marked, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(leaked)).distinct(), "pipeline-leaks"))
    return marked.join(found, F.col(key) == F.col(leaked), "left_anti").select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""
    rows = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return bpe.round_trip(rows, VOCABULARY, public_tokenizers.PATTERN).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encoding", encode_texts),
]

#: The classifier and the tokenizer have no SQL form; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
