"""Scalar text expressions: subjects, hashes, quotes, n-grams, tokens, redaction.

All are Column expressions; nothing here leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reply and forward prefixes, and which of them forward.
PREFIXES = ("RE", "AW", "FW", "WG", "SV", "VS", "Antw", "Doorst")
FORWARDS = ("FW", "WG", "VS", "DOORST")

# The transliteration of German letters.
GERMAN = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))

# What privacy modes hide.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?:(?:\+|00)\d[\d\s()./-]{6,}\d|\b\d{3,}[\d\s()./-]{4,}\d\b)"
PRIVILEGED_TERMS = ("privileged", "attorney-client", "counsel", "legal strategy", "litigation strategy", "counsel memo", "work product")
MEDICAL_TERMS = ("medical", "diagnosis", "doctor", "physician", "therap", "krank", "disability", "behinderung", "schwerbehind", "betriebsarzt", "medical recommendation")
MODES = {"full_access": (), "contact_redacted": ("contact",), "sensitive_redacted": ("contact", "privileged", "medical"), "strict_redaction": ("contact", "privileged", "medical")}


def base_subject(subject: Column) -> Column:
    """The subject without its leading reply and forward marks."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(subject, F.lit(""))), rf"(?i)^(?:(?:{'|'.join(PREFIXES)})\s*:\s*)+", ""))


def message_type(subject: Column, in_reply_to: Column) -> Column:
    prefix = F.upper(F.regexp_extract(F.trim(F.coalesce(subject, F.lit(""))), rf"(?i)^({'|'.join(PREFIXES)})\s*:", 1))
    return F.when(prefix.isin(*FORWARDS), "forward").when(prefix != "", "reply").when(F.coalesce(in_reply_to, F.lit("")) != "", "reply").otherwise("original")


def canonical_uid(message_id: Column, *parts: Column) -> Column:
    """SHA-256 of the message id, else of the other parts joined by a pipe."""
    key = F.trim(F.coalesce(message_id, F.lit("")))
    rest = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.sha2(F.when(key != "", key).otherwise(rest), 256)


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\u0085   -     　]+", " "))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct lower-cased n-grams of the squeezed text; a shorter text is its own."""

    def grams(chars: Column) -> Column:
        at = lambda i: F.concat(*(F.element_at(chars, i + k) for k in range(n)))
        full = F.transform(F.sequence(F.lit(1), F.size(chars) - (n - 1)), at)
        return F.when(F.size(chars) >= n, F.array_distinct(full)).when(F.size(chars) > 0, F.array(F.array_join(chars, ""))).otherwise(F.array().cast("array<string>"))

    return bind(F.filter(F.split(F.lower(squeeze(text)), ""), lambda c: c != ""), grams)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def words(text: Column) -> Column:
    """Unicode word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def letter_words(text: Column) -> Column:
    """Runs of letters of the lower-cased text, apostrophes inside kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+(?:'\p{L}+)?"), F.lit(0))


def csv_safe(value: Column) -> Column:
    """Cells that a spreadsheet would read as a formula start with an apostrophe."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def sanitize(text: Column) -> Column:
    """Without terminal escapes, bidirectional controls and control characters (tab and line ends stay)."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "\x1b\\][^\x07\x1b]*(?:\x07|\x1b\\\\)", "")
    out = F.regexp_replace(out, "\x1b\\[[0-?]*[ -/]*[@-~]", "")
    return F.regexp_replace(out, "[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u009f؜‎‏‪-‮⁦-⁩]", "")


def redact(text: Column, mode: str) -> tuple[Column, Column]:
    """The text under a privacy mode, and how many contacts were hidden."""
    rules, out = MODES[mode], F.coalesce(text, F.lit(""))
    hidden = F.lit(0)
    if "contact" in rules:
        hidden = F.regexp_count(out, F.lit(EMAIL))
        out = F.regexp_replace(out, EMAIL, "[REDACTED: email]")
        hidden = hidden + F.regexp_count(out, F.lit(PHONE))
        out = F.regexp_replace(out, PHONE, "[REDACTED: phone]")
    for name, terms in (("privileged", PRIVILEGED_TERMS), ("medical", MEDICAL_TERMS)):
        if name in rules:
            found = reduce(Column.__or__, (F.contains(F.lower(out), F.lit(t)) for t in terms))
            out = F.when(found, F.lit(f"[REDACTED: {name} content]")).otherwise(out)
    return out, hidden


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def sentences(text: Column) -> Column:
    """Split where white space follows an end mark and precedes a capital; over 10 characters."""
    parts = F.split(squeeze(text), r"(?<=[.!?]) (?=\p{Lu})")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 10)
