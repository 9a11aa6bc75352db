"""Secret scan by corpus-wide ownership frequency.

Patterns find candidate values with their code-point spans.  The hash of each
value is then counted over the whole corpus: in how many repositories and under
how many owners does it occur?  A value that more than ``max_owners`` owners hold
is a widely copied example; any other is owner-specific and live-looking.

Base kinds (assign, access, hex) are always reported, and the counts say how many
of them look live.  The wider kinds (bearer tokens, credentials in URLs, prefixed
tokens, mixed opaque strings) are reported only when owner-specific, since their
patterns alone also match examples that everyone copies.

Everything is a column expression.  ``split`` and ``regexp_extract_all`` give the
gaps and the matches of one pattern, whose running lengths are the spans.  After
that scan only hashes and offsets are kept.  Owners are counted in two steps,
(hash, owner, repository) first, so that a value in a third of all rows has
collapsed before it shuffles; the join back has plain exchanges that AQE splits.

Defined cases: null and empty texts have no spans; a null repository counts as one
repository of its own; repeated rows each get the full result; an empty table
gives an empty result; values are kept as hashes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Kinds in the order of listing: name, pattern, group of the value, least length of the value.
BASE_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),  # the same as AKIA[A-Z0-9]+ of 16 and more
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # the same as [0-9a-f]+ of 32 and more
)
WIDER_KINDS = (
    ("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/-]{16,})", 1, 16),
    ("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s:@/]{1,64}:([^\s@/]{6,})@", 1, 6),
    ("prefixed", r"\b(?:gh[pousr]_|glpat-|xox[abp]-|sk-|sk_live_|AIza)[A-Za-z0-9_-]{16,}", 0, 20),
    ("opaque", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{24,}", 0, 24),
)
KINDS = BASE_KINDS + WIDER_KINDS
_SPAN = "struct<start:int,rank:int,stop:int,value:string>"


def _find(text: Column, rank: int) -> Column:
    """Array of spans of one kind; offsets are code points, the end exclusive."""
    _, pattern, group, least = KINDS[rank]
    regex = F.lit(pattern)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("match"), (F.regexp_extract_all(text, regex, F.lit(group)) if group else whole).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("found"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.length(part["gap"])
        stop = begin + F.coalesce(F.length(part["match"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.sha2(part["value"], 256).alias("value"))
        good = part["match"].isNotNull() & (F.length(part["value"]) >= least)
        return F.struct(stop.alias("at"), F.when(good, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(parts, start, step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str | None) -> DataFrame:
    """doc_id, text_hash, repo, owner, spans (sorted by start, then kind)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    owner = F.col(owner_col) if owner_col else F.substring_index(F.col(repo_col), "/", 1)
    found = F.array_sort(F.concat(*(_find(text, k) for k in range(len(KINDS)))))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        found.alias("spans"),
    )


def ownership(rows: DataFrame) -> DataFrame:
    """value, owners, repos, occurrences over the whole corpus."""
    by_repo = rows.select("owner", "repo", F.explode("spans.value").alias("value")).groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("occurrences"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["stop"])), ",")


def _of_rank(rank: int):
    return lambda span: span["rank"] == rank


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None, max_owners: int = 3) -> DataFrame:
    """One row per document: the counts and digest of base spans, all spans, and how many look live."""
    rows = stage(candidates(docs, id_col, text_col, repo_col, owner_col), "secret-rows")
    copied = stage(ownership(rows).where(F.col("owners") > max_owners).select("value", "owners"), "secret-copied")
    with_spans = rows.where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    each = with_spans.select("doc_id", "text_hash", F.explode("spans").alias("span")).withColumn("value", F.col("span.value"))
    judged = each.join(copied, "value", "left").select("doc_id", "text_hash", F.struct("span.start", "span.rank", "span.stop", F.col("owners").isNull().alias("live")).alias("span"))
    per_doc = judged.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("span")).alias("judged"))
    per_doc = per_doc.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "judged")
    none = F.array().cast("array<struct<start:int,rank:int,stop:int,live:boolean>>")
    out = rows.select("doc_id", "text_hash").join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    out = out.withColumn("judged", F.coalesce("judged", none))
    base = F.filter("judged", lambda s: s["rank"] < len(BASE_KINDS))
    count = lambda test: F.size(F.filter("judged", test)).cast("long")
    return out.select(
        "doc_id",
        *(F.size(F.filter("judged", _of_rank(k))).cast("long").alias(f"n_{KINDS[k][0]}") for k in range(len(BASE_KINDS))),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.filter("judged", lambda s: (s["rank"] < len(BASE_KINDS)) | s["live"])).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_copied"),
    )
