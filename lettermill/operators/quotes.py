"""Quotes found in surfaces: exactly, by letters and digits alone, or nearly.

The ladder of a pair: the quote's squeezed and case-folded form is part of the
surface's, or, where it has at least 24 of them, its ASCII letters and digits are
(exact); else the same of both with words joined over line ends and German letters
written out (near_exact).

Quotes never meet all surfaces.  A long quote is found by anchors: of every window of
``WINDOW`` runs of ``GRAM`` characters the one of least hash is kept, on both sides
alike, so whatever holds the quote shares all the anchors of its inside.  Anchors of
surfaces that no quote has are dropped where they arise or by a semi join, those left are counted, and
each quote is looked up by the rarest of its own in an equi-join.  Quotes too short
for a window are looked up by the hash of the whole quote among all runs of its
length.  What meets is then verified by the ladder itself, so anchors decide cost and
never the result.

Defined cases: quotes that are null or blank match nothing; null surfaces hold
nothing; repeated rows of either side match each; tables without rows give none.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import GERMAN
from .staging import small, stage

# Typographic marks with their plain form, ligatures, hyphens, and the least number of letters and digits.
MARKS = {"“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "’": "'", "‘": "'", "‚": "'", "–": "-", "—": "-", "−": "-", "…": "..."}
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl"}
HYPHENS = "-‐‑‒–"
LEAST = 24

#: A window of so many runs of so many characters: LEAST characters fill one.
GRAM, WINDOW = 12, LEAST - 12 + 1
#: Anchors and short quotes that are sent to every task at once; beyond it anchors are joined, short quotes go in blocks.
SENT = 2_000_000

_TYPOGRAPHIC = re.compile("[" + "".join([*MARKS, *LIGATURES]) + "]")
_PLAIN = MARKS | LIGATURES
_BROKEN = re.compile(rf"(?<=[^\W_])[{re.escape(HYPHENS)}][ \t]*(?:\r\n|\r|\n)[ \t]*(?=[^\W_])")
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalnum())


def _letters(form: str) -> str:
    return form.encode("ascii", "ignore").translate(None, _NO_LETTERS).decode()


def forms(text: str) -> tuple[str, str, str]:
    """The squeezed form of a text, its letters and digits, and those of the near form."""
    plain = text if text.isascii() else _TYPOGRAPHIC.sub(lambda m: _PLAIN[m[0]], unicodedata.normalize("NFKC", text))
    squeezed = " ".join(plain.split()).casefold()
    letters = _letters(squeezed)
    joined = _BROKEN.sub("", plain)
    near = squeezed if joined == plain else joined.casefold()
    if near.isascii():
        return squeezed, letters, letters if near is squeezed else _letters(near)
    for mark, written in GERMAN:
        near = near.replace(mark, written)
    return squeezed, letters, _letters(near)


def state(quote: tuple[str, str, str], surface: tuple[str, str, str]) -> str:
    if not quote[0]:
        return "unverified"
    if quote[0] in surface[0] or (len(quote[1]) >= LEAST and quote[1] in surface[1]):
        return "exact"
    return "near_exact" if len(quote[2]) >= LEAST and quote[2] in surface[2] else "unverified"


def match_state(quote: Column, surface: Column) -> Column:
    """exact, near_exact, unverified, or orphaned without a surface."""

    @F.pandas_udf("string")
    def rate(quotes, surfaces):
        import pandas as pd

        known = lru_cache(64)(forms)
        return pd.Series([state(known(q or ""), known(s)) for q, s in zip(quotes, surfaces, strict=True)], dtype=object)

    # computed once, also where a filter on it is pushed down
    rate = rate.asNondeterministic()
    return F.when(surface.isNull(), "orphaned").otherwise(rate(F.coalesce(quote, F.lit("")), F.coalesce(surface, F.lit(""))))


# Anchors


def _rolling(codes: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of every run of ``length`` codes."""
    out = np.full(max(0, len(codes) - length + 1), seed, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            out = (out ^ codes[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def _codes(form: str) -> np.ndarray:
    return np.frombuffer(form.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def anchors(form: str, seed: int, block: int = 1 << 18) -> np.ndarray:
    """Distinct least hashes of all windows of a form; none if it is shorter than a window."""
    codes, found = _codes(form), [np.zeros(0, np.uint64)]
    for low in range(0, max(1, len(codes) - LEAST + 1), block):
        hashes = _rolling(codes[low : low + block + LEAST - 1], GRAM, seed)
        if len(hashes) >= WINDOW:
            found.append(np.unique(np.lib.stride_tricks.sliding_window_view(hashes, WINDOW).min(axis=1)))
    return np.unique(np.concatenate(found))


def _kinds(quote: tuple[str, str, str]) -> str:
    """How a quote is looked up: ``letters``, ``whole`` (squeezed form, few letters) or ``short``."""
    if len(quote[1]) >= LEAST:
        return "letters"
    return "whole" if len(quote[0]) >= LEAST else "short"


def _quote_rows(batches):
    """(qid, kind, hash, length): the anchors of quotes, and the hash of whole short ones.

    A quote with letters enough in one form only is looked up for the other by its own rule.
    """
    for batch in batches:
        rows = []
        for qid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            form = forms(text)
            if not form[0]:
                continue
            kind = _kinds(form)
            if kind == "letters":
                rows += [(qid, "exact", int(h), LEAST) for h in anchors(form[1], 1)]
            elif kind == "whole":
                rows += [(qid, "whole", int(h), LEAST) for h in anchors(form[0], 2)]
            else:
                codes = _codes(form[0])
                rows.append((qid, "short", int(_rolling(codes, len(codes), 3)[0]), len(codes)))
            if len(form[2]) >= LEAST and (kind != "letters" or form[2] != form[1]):
                rows += [(qid, "near", int(h), LEAST) for h in anchors(form[2], 1)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(np.array(columns[2], np.uint64).view(np.int64)), pa.array(columns[3], pa.int32())], names=["qid", "kind", "hash", "length"])


def _surface_rows(shared):
    """(sid, hash): anchors of surfaces, and the runs that are a short quote's."""
    wanted, whole, short = shared

    def run(batches):
        known, lengths = (wanted.value if wanted else None), (short.value if short else {})
        for batch in batches:
            for k in range(batch.num_rows):
                form = forms(batch.column(1)[k].as_py())
                own = [anchors(form[1], 1), anchors(form[2], 1) if form[2] != form[1] else np.zeros(0, np.uint64)]
                if whole:
                    own.append(anchors(form[0], 2))
                found = np.unique(np.concatenate(own))
                if known is not None and len(found):
                    found = found[known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found] if len(known) else found[:0]
                if lengths:
                    codes = _codes(form[0])
                    for length, hashes in lengths.items():
                        runs = np.unique(_rolling(codes, length, 3))
                        if len(runs):
                            found = np.concatenate([found, runs[hashes[np.minimum(np.searchsorted(hashes, runs), len(hashes) - 1)] == runs]])
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(found), batch.schema.field(0).type), pa.array(found.view(np.int64))], names=["sid", "hash"])

    return run


def match(quotes: DataFrame, surfaces: DataFrame, sent: int = SENT) -> DataFrame:
    """(qid, sid, state) of all matching pairs of ``quotes`` (qid, text) and ``surfaces`` (sid, text)."""
    spark = quotes.sparkSession
    qid, sid = (df.schema[c].dataType.simpleString() for df, c in ((quotes, "qid"), (surfaces, "sid")))
    asked = stage(quotes.where("text is not null and qid is not null").groupBy("qid", "text").agg(F.count(F.lit(1)).alias("times")), "quotes")
    # an id may have several texts
    asked = asked.withColumn("key", F.xxhash64("qid", "text"))
    given = surfaces.where("text is not null and sid is not null").withColumn("key", F.xxhash64("sid", "text"))
    rows = stage(asked.select("key", "text").mapInArrow(_quote_rows, "qid long, kind string, hash long, length int"), "quote-anchors").distinct()
    rows = stage(rows, "quote-anchors")
    result = f"qid {qid}, sid {sid}, state string"
    counts = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], result)

    anchored, brief = rows.where("kind <> 'short'"), rows.where("kind = 'short'")
    few = sum(n for kind, n in counts.items() if kind != "short") <= sent
    wanted = None
    if few:
        wanted = spark.sparkContext.broadcast(np.sort(np.array([r["hash"] for r in anchored.select("hash").distinct().collect()], np.int64).view(np.uint64)))
    parts, hits = -(-counts.get("short", 0) // sent), None
    for part in range(max(1, parts)):
        own = {}
        for r in brief.where(F.pmod("hash", F.lit(max(1, parts))) == part).select("hash", "length").distinct().collect() if parts else ():
            own.setdefault(r["length"], []).append(r["hash"])
        short = spark.sparkContext.broadcast({n: np.sort(np.array(h, np.int64).view(np.uint64)) for n, h in own.items()}) if own else None
        # anchors are looked for in the first pass alone
        first = part == 0
        found = given.select("key", "text").mapInArrow(_surface_rows((wanted if first else spark.sparkContext.broadcast(np.zeros(0, np.uint64)), first and "whole" in counts, short)), "sid long, hash long")
        hits = found if hits is None else hits.unionByName(found)
    hits = stage(hits if few else hits.join(rows.select("hash").distinct(), "hash", "left_semi"), "quote-hits")

    # every way to find a quote by the rarest of its anchors; a surface that lacks it does not hold the quote
    often = hits.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    rated = rows.join(often, "hash", "left").groupBy("qid", "kind").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash")).alias("best"))
    keys = rated.where("best.n > 0").select("qid", F.col("best.hash").alias("hash"))
    pairs = stage(hits.join(small(stage(keys, "quote-keys")), "hash").select("qid", "sid").distinct(), "quote-pairs")

    texts = given.select(F.col("key").alias("sid"), F.col("sid").alias("own_sid"), F.col("text").alias("surface")).groupBy("sid", "own_sid", "surface").agg(F.count(F.lit(1)).alias("repeats"))
    texts = texts.join(small(stage(pairs.select("sid").distinct(), "quote-surfaces")), "sid", "left_semi")
    met = pairs.join(asked.select(F.col("key").alias("qid"), F.col("qid").alias("own_qid"), "text", "times"), "qid").join(texts, "sid")
    rated = met.select("own_qid", "own_sid", "times", "repeats", match_state(F.col("text"), F.col("surface")).alias("state")).where("state <> 'unverified'")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times") * F.col("repeats")))
    return rated.select("own_qid", "own_sid", "state", copies.alias("copy")).select(F.col("own_qid").alias("qid"), F.col("own_sid").alias("sid"), "state")


def verified(quotes: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(total, exact, near_exact): how many quotes there are, and how many are found in some surface, each by its best state."""
    best = match(quotes, surfaces).groupBy("qid").agg(F.min("state").alias("state"))  # exact comes before near_exact
    both = quotes.select("qid").join(best, "qid", "left")
    return both.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("state") == "exact", 1)).alias("exact"), F.count(F.when(F.col("state") == "near_exact", 1)).alias("near_exact"))


__all__ = ["forms", "match", "match_state", "state", "verified"]
