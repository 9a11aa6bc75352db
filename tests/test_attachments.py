"""Attachment text by format, and its bounds."""

import io
import zipfile

from pyspark.sql import functions as F

from lettermill.sources import attachments


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, content in members.items():
            archive.writestr(name.replace("__", "."), content)
    return out.getvalue()


def test_formats():
    assert attachments.extract("a.txt", "Grüße".encode()) == ("Grüße", "extracted")
    assert attachments.extract("a.csv", "Grüße".encode("latin-1")) == ("Grüße", "extracted")
    assert attachments.extract("a.txt", "text".encode("utf-16-le")) == ("text", "extracted")
    assert attachments.extract("a.html", b"<p>One<br>two</p>") == ("One\ntwo", "extracted")
    text, _ = attachments.extract("m.eml", b"From: a@b.org\nSubject: Hi\nContent-Type: text/plain\n\nBody\n")
    assert text == "From: a@b.org\nSubject: Hi\n\nBody"
    text, _ = attachments.extract("x.zip", zipped(a__txt="inside", b__png="binary"))
    assert "a.txt\ninside" in text and "- b.png (6 bytes)" in text
    assert attachments.extract("x.zip", b"PK broken") == (None, "failed")
    assert attachments.extract("x.pdf", b"%PDF") == (None, "unsupported")
    assert attachments.extract("x.txt", b"") == (None, "empty") and attachments.extract(None, None) == (None, "empty")


def test_mime_type_decides_only_for_unknown_names():
    assert attachments.extension("blob.bin", "text/plain; charset=utf-8") == ".txt"
    assert attachments.extension("a.html", "text/plain") == ".html" and attachments.extension(".hidden") == ""


def test_long_texts_are_cut():
    text, state = attachments.extract("a.txt", b"x" * 60_000)
    assert state == "extracted" and len(text) == attachments.MAX_CHARS + len(attachments.CUT)


def test_columns(spark):
    rows = spark.createDataFrame([("a.txt", bytearray(b"hello"), None), ("b", bytearray(b"<p>x</p>"), "text/html"), (None, None, None)], "name string, content binary, mime string")
    got = rows.select(attachments.extract_columns(F.col("name"), F.col("content"), F.col("mime")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("hello", "extracted"), ("x", "extracted"), (None, "empty")]
