"""Text of attachments: plain text, HTML, mail files and zip archives, chosen by extension.

Formats whose libraries are absent, images and binaries give no text.  A text is cut
at ``MAX_CHARS`` with a mark that says so; of an archive the first ``MAX_MEMBERS``
members of at most ``MAX_MEMBER_BYTES`` are read, and all are listed.
"""

from __future__ import annotations

import email
import email.policy
import io
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bodies import html_to_text

# Bounds, headings, and which extensions hold text.
MAX_CHARS, MAX_MEMBERS, MAX_MEMBER_BYTES = 50_000, 20, 2_000_000
CUT = "\n[... content truncated ...]"
MEMBER_TEXT, MEMBER_LIST = "[Archive extracted member text]", "[Archive member inventory]"
TEXT_EXTENSIONS = (".txt", ".csv", ".log", ".md", ".json", ".xml", ".yaml", ".yml", ".ini", ".cfg", ".conf", ".tsv", ".rst", ".ics", ".ical", ".vcs")
BY_MIME = {
    "text/plain": ".txt", "text/csv": ".csv", "text/tab-separated-values": ".tsv", "application/json": ".json", "text/xml": ".xml", "application/xml": ".xml",
    "text/html": ".html", "application/xhtml+xml": ".html", "text/calendar": ".ics", "application/ics": ".ics",
}
MIME_DECIDES = ("", ".bin", ".dat")


def extension(name: str | None, mime_type: str | None = None) -> str:
    """The extension of a name; the MIME type decides only where that says nothing."""
    base = (name or "").rpartition("/")[2]
    ext = base[base.rfind(".") :].lower() if base.rfind(".") > 0 else ""
    by_mime = BY_MIME.get((mime_type or "").partition(";")[0].strip().lower(), "")
    return by_mime if by_mime and ext in MIME_DECIDES else ext


def decode(content: bytes) -> str:
    """UTF-8 or UTF-16 by mark or by where the zero bytes are, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    head = content[:2000]
    if len(head) > 3 and head[1::2].count(0) > 0.6 * len(head[1::2]):
        return content.decode("utf-16-le", "replace")
    if len(head) > 3 and head[::2].count(0) > 0.6 * len(head[::2]):
        return content.decode("utf-16-be", "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def _mail(content: bytes) -> str:
    message = email.message_from_bytes(content, policy=email.policy.default)
    lines = [f"{name}: {message[name]}" for name in ("From", "To", "Cc", "Date", "Subject") if message[name]]
    part = message.get_body(preferencelist=("plain", "html"))
    body = part.get_content() if part is not None else ""
    if part is not None and part.get_content_subtype() == "html":
        body = html_to_text(body)
    return "\n".join([*lines, "", body.strip()])


def _archive(content: bytes) -> str:
    texts, names = [], []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for k, info in enumerate(i for i in archive.infolist() if not i.is_dir()):
            names.append(f"- {info.filename} ({info.file_size} bytes)")
            kind = extension(info.filename)
            if k < MAX_MEMBERS and info.file_size <= MAX_MEMBER_BYTES and kind in (*TEXT_EXTENSIONS, ".html", ".htm", ".eml"):
                text = extract(info.filename, archive.read(info))[0]
                if text:
                    texts.append(f"{info.filename}\n{text}")
    return "\n\n".join(([f"{MEMBER_TEXT}\n" + "\n\n".join(texts)] if texts else []) + ([f"{MEMBER_LIST}\n" + "\n".join(names)] if names else []))


def extract(name: str | None, content: bytes | None, mime_type: str | None = None) -> tuple[str | None, str]:
    """(text, state): extracted, empty, unsupported or failed."""
    kind = extension(name, mime_type)
    if not content:
        return None, "empty"
    readers = dict.fromkeys(TEXT_EXTENSIONS, decode) | dict.fromkeys((".html", ".htm", ".xhtml"), lambda c: html_to_text(decode(c))) | {".eml": _mail, ".zip": _archive}
    if kind not in readers:
        return None, "unsupported"
    try:
        text = readers[kind](content).strip()
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, LookupError, ValueError):
        return None, "failed"
    if not text:
        return None, "empty"
    return (text if len(text) <= MAX_CHARS else text[:MAX_CHARS] + CUT), "extracted"


def extract_columns(name: Column, content: Column, mime_type: Column) -> Column:
    """struct(text, state) of attachment columns, in Arrow batches."""

    def run(names: pd.Series, contents: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(n, c, k) for n, c, k in zip(names, contents, kinds, strict=True)], columns=["text", "state"])

    return F.pandas_udf(run, "text string, state string")(name, content, mime_type)
