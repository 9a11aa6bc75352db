"""Mail fields: dates, headers, addresses, attachment identity, body states."""

from __future__ import annotations

import email.header
from datetime import UTC
from email.utils import parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# What introduces a header of a text chunk.
CHUNK_HEADERS = ("Date:", "From:", "To:", "CC:", "Subject:", "Folder:", "Categories:", "Attachments:", "Type:", "Priority:", "Relevance:", "Has attachments")


def normalize_date(value: Column) -> Column:
    """ISO 8601 or RFC 2822 text as ISO 8601 in UTC; a time without zone stays without one; else an empty string."""
    text = F.trim(F.coalesce(value, F.lit("")))
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}T")
    zoned = text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    out = "yyyy-MM-dd'T'HH:mm:ss"
    utc = lambda x: F.concat(F.date_format(x, out), F.lit("+00:00"))
    rest = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)$", "")
    mailed = F.try_to_timestamp(rest, F.lit("d MMM yyyy HH:mm:ss Z"))
    found = F.when(iso & zoned, utc(F.try_to_timestamp(text))).when(iso, F.date_format(F.try_to_timestamp(text), out)).otherwise(utc(mailed))
    return F.coalesce(found, F.lit(""))


def _exact_date(value: str | None) -> str:
    try:
        parsed = parsedate_to_datetime(value)
    except (TypeError, ValueError, OverflowError):
        return ""
    return (parsed.astimezone(UTC) if parsed.tzinfo else parsed.replace(tzinfo=UTC)).isoformat()


def _decoded(value: str | None) -> str | None:
    if not value or "=?" not in value:
        return value
    try:
        return str(email.header.make_header(email.header.decode_header(value)))
    except (LookupError, ValueError):
        return value


def normalize_date_exact(value: Column) -> Column:
    """As :func:`normalize_date`, for every date that the mail grammar allows, named zones included."""
    return F.pandas_udf(lambda values: values.map(_exact_date), "string")(value)


def decode_words(value: Column) -> Column:
    """RFC 2047 encoded words of a header, decoded."""
    return F.pandas_udf(lambda values: values.map(_decoded), "string")(value)


def unfold(header: Column) -> Column:
    """Continuation lines of a header joined by one space."""
    return F.regexp_replace(header, r"\r?\n[ \t]+", " ")


def parse_address(raw: Column) -> Column:
    """struct(name, address) of ``Name <addr>``, a bare address or a bare name."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    angled = F.regexp_extract(text, r"^(.*?)\s*<([^<>]+)>$", 2)
    name = F.trim(F.regexp_replace(F.regexp_extract(text, r"^(.*?)\s*<([^<>]+)>$", 1), '^"|"$', ""))
    bare = F.contains(text, F.lit("@"))
    return F.struct(F.when(angled != "", name).when(bare, "").otherwise(text).alias("name"), F.lower(F.when(angled != "", F.trim(angled)).when(bare, text).otherwise("")).alias("address"))


def sender_line(name: Column, address: Column) -> Column:
    n, a = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(address, F.lit("")))
    return F.when((n != "") & (a != ""), F.concat(n, F.lit(" <"), a, F.lit(">"))).when(n != "", n).otherwise(a)


def chunk_header(fields: dict[str, Column], categories: Column | None = None, attachments: Column | None = None) -> Column:
    """The header lines of a chunk; fields without a value are left out."""
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{label}: "), v)) for label, v in fields.items()]
    for label, values in (("Categories", categories), ("Attachments", attachments)):
        if values is not None:
            lines.append(F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(values, 1, 5), ", "))))
    return F.concat_ws("\n", *lines)


def without_header(text: Column) -> Column:
    """A chunk's text without its leading header lines."""
    starts = "|".join(s.replace("[", r"\[") for s in CHUNK_HEADERS)
    pattern = rf"^(?:[ \t]*(?:{starts}|\[Calendar/Meeting\]|\[Part \d+/\d+\])[^\n]*\n?)(?:[ \t]*(?:{starts}|\[Calendar/Meeting\]|\[Part \d+/\d+\])[^\n]*\n?|[ \t]*\n)*"
    return F.when(text.rlike(pattern), F.trim(F.regexp_replace(text, pattern, ""))).otherwise(text)


def truncate(text: Column, limit: int) -> Column:
    """The first ``limit`` characters and a note of both lengths."""
    size = F.length(text)
    note = F.concat(F.lit(f"\n[...truncated at {limit:,}/"), F.format_number(size, 0), F.lit(" chars]"))
    return F.when(size <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), note))


def attachment_id(name: Column, mime_type: Column, size: Column, content_id: Column, content_sha256: Column) -> Column:
    """``sha256:`` and the content hash, else ``meta:`` and the hash of a sorted JSON fingerprint."""
    low = lambda c: F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " "))
    print_ = F.to_json(F.struct(low(content_id).alias("content_id"), low(name).alias("filename"), low(mime_type).alias("mime_type"), F.coalesce(size, F.lit(0)).cast("long").alias("size")))
    return F.when(low(content_sha256) != "", F.concat(F.lit("sha256:"), low(content_sha256))).otherwise(F.concat(F.lit("meta:"), F.sha2(print_, 256)))


def search_text(text: Column) -> Column:
    """Attachment text for searching: broken words joined, ligatures and German letters plain, squeezed, lower case."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.lower(F.trim(F.regexp_replace(out, r"\s+", " ")))


def body_state(clean: Column, raw_text: Column, raw_html: Column, preview: Column, source: Column, email_type: Column, has_attachments: Column) -> Column:
    """struct(kind, reason, strategy, confidence): what an empty body is, and what could stand in for it."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    shown_html = filled(F.regexp_replace(F.coalesce(raw_html, F.lit("")), r"<[^>]*>|&nbsp;", ""))
    body, reply = filled(raw_text) | shown_html, email_type.isin("reply", "forward")
    image = F.coalesce(raw_html, F.lit("")).rlike("(?i)<img") & ~shown_html
    reason = (
        F.when(image, "image_only")
        .when(filled(source) & ~body, "source_shell_only")
        .when(filled(raw_html) & ~body, "html_shell_only")
        .when(has_attachments & ~body, "attachment_only")
        .when(reply & ~body, "metadata_only_reply")
        .otherwise("true_blank")
    )
    strategy = F.when(reason == "attachment_only", "").when(filled(preview), "preview").when(filled(source), "source").when(reason.isin("image_only", "metadata_only_reply"), "summary").otherwise("")
    trust = F.when(strategy == "preview", 0.7).when(strategy == "source", 0.5).when(strategy == "summary", 0.2).otherwise(0.0)
    kind = F.when(reason == "attachment_only", "attachment_only").when(strategy != "", "content").when(reply, "metadata_only").otherwise("empty")
    empty = F.struct(kind.alias("kind"), reason.alias("reason"), strategy.alias("strategy"), trust.alias("confidence"))
    return F.when(filled(clean), F.struct(F.lit("content").alias("kind"), F.lit("").alias("reason"), F.lit("").alias("strategy"), F.lit(1.0).alias("confidence"))).otherwise(empty)
