"""From search results to an answer: lanes and expansion of queries, evidence scores, confidence, decision, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import squeeze

# What verification, source and calibration are worth, and the bounds of confidence.
CALIBRATION = {"calibrated": 0.03, "synthetic": -0.02}
EXACT_STATES = ("retrieval_exact", "forensic_exact", "hybrid_verified_forensic", "segment_exact")
EXACT_WORDING = {"forensic_exact": 0.07, "segment_exact": 0.07, "retrieval_exact": 0.04, "hybrid_verified_forensic": 0.04}
WEAK_STATES = ("thread_context", "attachment_reference", "mixed_source_reference")
EXACT_SOURCES = ("forensic_body_text", "message_segments", "quoted_reply")
CLOSE_GAP, HIGH_SCORE, HIGH_GAP, LOW_SCORE = 0.03, 0.85, 0.15, 0.6
# Characters of a snippet by its standing, in the first and in the second phase.
BUDGETS = {"primary": (220, 180, 140, 100), "secondary": (140, 110, 80, 60)}
ASCII = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"))


def _worth(value: Column, table: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, worth in table.items():
        out = F.when(value == name, worth).otherwise(out)
    return out


def evidence_score(score: Column, calibration: Column, score_kind: Column, has_attachment: Column, verification: Column, source: Column, exact_wording: Column) -> Column:
    """The score evidence is ranked by: its own, and what calibration, origin and, where the wording matters, verification add."""
    flag = lambda test, worth: F.when(F.coalesce(test, F.lit(False)), worth).otherwise(0.0)
    base = score + _worth(calibration, CALIBRATION) + flag(score_kind == "segment_sql", 0.015) + flag(has_attachment, 0.01) + flag(verification.isin(*EXACT_STATES), 0.015)
    wording = _worth(verification, EXACT_WORDING) + flag(source.isin(*EXACT_SOURCES), 0.02) + flag(verification.isin(*WEAK_STATES), -0.025)
    return base + F.when(F.coalesce(exact_wording, F.lit(False)), wording).otherwise(0.0)


def answer_quality(items: DataFrame, by: str, uid: str, score: str) -> DataFrame:
    """One row a question: its best item, the gap to the next, confidence, why it is ambiguous, and runners-up 2 and 3 unless confidence is high."""
    order = Window.partitionBy(by).orderBy(F.desc(score), uid)
    top = items.withColumn("r", F.row_number().over(order)).where("r <= 3")
    at = lambda k, column: F.max(F.when(F.col("r") == k, F.col(column)))
    best = top.groupBy(by).agg(at(1, uid).alias("top_uid"), at(1, score).alias("top_score"), at(2, score).alias("second"), at(2, uid).alias("u2"), at(3, uid).alias("u3"))
    gap = F.col("top_score") - F.coalesce("second", F.lit(0.0))
    close, high, low = F.col("second").isNotNull() & (gap <= CLOSE_GAP), (F.col("top_score") >= HIGH_SCORE) & (gap >= HIGH_GAP), F.col("top_score") < LOW_SCORE
    label = F.when(close, "ambiguous").when(high, "high").when(low, "low").otherwise("medium")
    reason = F.when(close, "close_top_scores").when(high, "").when(low, "weak_top_score").otherwise("")
    rest = F.when(label == "high", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.col("u2").cast("string"), F.col("u3").cast("string"))))
    return best.select(by, "top_uid", "top_score", gap.alias("gap"), label.alias("confidence"), reason.alias("reason"), rest.alias("alternatives"))


def answer_policy(quality: DataFrame, weak: Column, exact_wording: Column, evidence_mode: str = "retrieval") -> DataFrame:
    """``quality`` with decision, verification_mode, max_citations, citations and the phrase an answer opens with."""
    label = F.col("confidence")
    decision = F.when(label == "ambiguous", "ambiguous").when((label == "low") | F.col("reason").isin("no_evidence", "weak_top_score", "weak_scan_body") | weak, "insufficient_evidence").otherwise("answer")
    checks = F.when(exact_wording | label.isin("ambiguous", "medium") | weak, "verify_forensic").otherwise("retrieval_ok")
    cited = F.concat(F.array(F.col("top_uid").cast("string")), F.col("alternatives"))
    most = F.when(decision == "ambiguous", F.least(F.lit(2), F.size(cited))).otherwise(1)
    phrase = F.when(decision != "answer", "The available evidence is limited").when(label == "high", "The evidence strongly indicates").otherwise("The available evidence suggests")
    verification = F.lit("already_forensic") if evidence_mode == "forensic" else checks
    return quality.select("*", decision.alias("decision"), verification.alias("verification_mode"), F.slice(cited, F.lit(1), most).alias("citations"), phrase.alias("confidence_phrase"))


def strength(has_attachment: Column, strong: Column, text_available: Column) -> Column:
    """3 for a body or an attachment of strong text, 2 for one with any text, else 1."""
    return F.when(~has_attachment | strong, 3).when(text_available, 2).otherwise(1)


def packing_key(strength_: Column, cited: Column, verification: Column, score: Column, rank: Column) -> Column:
    """What evidence is kept by, the least going first: strength, citation, verification, score, rank."""
    exact = verification.isin("retrieval_exact", "forensic_exact", "hybrid_verified_forensic")
    return F.struct(strength_.alias("strength"), cited.cast("int").alias("cited"), exact.cast("int").alias("exact"), F.contains(verification, F.lit("forensic")).cast("int").alias("forensic"), score.alias("score"), (-rank).alias("rank"))


def snippet_budget(key: Column, phase: str = "primary") -> Column:
    best, good, fair, least = BUDGETS[phase]
    return F.when((key["cited"] == 1) | (key["exact"] == 1), best).when((key["strength"] >= 3) | (key["forensic"] == 1), good).when(key["strength"] >= 2, fair).otherwise(least)


def rerank(results: DataFrame, logit: str, uid: str, by: tuple[str, ...] = (), top: int | None = None) -> DataFrame:
    """Results by a model's logits, least distance 1 - sigmoid first; a model's scores are a column, so any batch UDF can give them."""
    distance = 1 - 1 / (1 + F.exp(-F.least(F.greatest(F.col(logit), F.lit(-500.0)), F.lit(500.0))))
    placed = results.withColumn("distance", distance).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("distance", uid)))
    return placed if top is None else placed.where(F.col("place") <= top)


def scoped(query: Column, scope: str | None) -> Column:
    """The query of the dense channel, with an explicit scope named in a second line."""
    return query if scope in (None, "", "general") else F.concat(query, F.lit(f"\nRetrieval scope: {scope}"))


def ascii_form(text: Column) -> Column:
    for mark, plain in ASCII:
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def lanes(query: Column, related: Column, n_terms: int = 3, most: int = 4) -> Column:
    """The distinct lanes of a query, itself first: written in ASCII, and with its first related terms."""
    base = squeeze(query)
    more = F.array_join(F.slice(related, 1, n_terms), " ")
    found = F.array(base, ascii_form(base), F.when(more != "", F.concat(base, F.lit(" "), more)).otherwise(base))
    own = F.filter(found, lambda lane, i: (lane != "") & (F.array_position(F.transform(found, lambda x: F.lower(x)), F.lower(lane)) == i + 1))
    return F.slice(own, 1, most)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[\w-]+"), F.lit(0))


def expansion_terms(base: Column, lane: Column, executed: Column, suffix: Column) -> Column:
    """Distinct terms that an expansion brought: those of the suffix, then what lane and executed query have beyond the base."""
    beyond = lambda text: F.filter(_terms(text), lambda t: ~F.array_contains(_terms(base), t))
    return F.array_distinct(F.concat(_terms(suffix), beyond(lane), beyond(executed)))


def related_terms(near: DataFrame, queries: DataFrame, vocabulary: DataFrame, n_terms: int = 3, least_chars: int = 3) -> DataFrame:
    """(query_id, terms): the nearest vocabulary terms (query_id, vec_id, place) that the query does not hold yet as words."""
    named = near.join(vocabulary, "vec_id").join(queries.select("query_id", F.lower("text").alias("asked")), "query_id")
    inside = F.array_contains(_terms(F.col("asked")), F.lower("term"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    kept = named.where(~inside & (F.length("term") >= least_chars)).withColumn("r", place).where(F.col("r") <= n_terms)
    found = kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("terms"))
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
