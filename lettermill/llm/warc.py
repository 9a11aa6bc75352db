"""Zstandard WARC archives: one frame a record, dictionary in the leading frame.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; then every record is a Zstandard frame of its own, so a reader can
start at any record.  The dictionary is trained on at most ``DICTIONARY_SAMPLE``
payloads, those with the smallest hashes; it changes sizes, never contents.

Writing: each task packs its rows into archives of about ``ARCHIVE_BYTES`` in the
shared folder and returns a manifest row for each.  Names are unique, so a task
that runs again leaves an orphan file at most, and readers take what the staged
manifest names.  Reading: archives come as binary files, frames are walked by
their block headers without copying the rest, and each record's version line,
headers, lengths and digest are checked.

Of records with equal payloads of at least ``REVISIT_BYTES`` that with the
largest page id holds the payload; the others are revisit records, which keep the
HTTP header with the full length and name the digest and the record they refer
to.  Repeated payloads are found by digest with map-side aggregation; payloads
meet the list of repeated digests by broadcast while its checked size is under
``MAX_BROADCAST`` rows, else by a join whose skew AQE splits.

Defined cases: null payloads are empty; null ids are written as an empty id and
read as null, and are never chosen as the largest unless all are null; rows that
repeat the id of the response are responses too; a missing URL is replaced by the
record's own URN; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, small_batches, stage

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
ARCHIVE_BYTES = 8 << 20
DICTIONARY_SAMPLE = 256
DICTIONARY_CHARS = 16_384
DICTIONARY_BYTES = 32 << 10
REVISIT_BYTES = 1000
MAX_BROADCAST = 200_000
_DATE = "1970-01-01T00:00:00Z"  # pages have no date, and equal input must give equal records


class WarcError(ValueError):
    """A record or frame that breaks the format."""


# records


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    urn = f"urn:page:{'' if page_id is None else page_id}"
    uri = urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else urn
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{urn}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    return _record(headers, http + (b"" if revisit else payload))


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record, checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"no WARC version line: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"malformed header {line[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"header {name} is missing")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, Content-Length {length}")
    return headers, rest[:length]


def _urn_id(value: str | None) -> int | None:
    return int(tail) if value and (tail := value.strip("<>").rpartition(":")[2]) else None


def read_page(headers: dict[str, str], block: bytes) -> dict:
    """The fields of a response or revisit record, checked against its digest."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no end of the HTTP header")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    digest, size, kind = headers["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"]), headers["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise WarcError("the payload does not match its length or digest")
    if kind == "revisit" and payload:
        raise WarcError("a revisit record with a payload")
    return {
        "page_id": _urn_id(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "record_type": kind, "payload_bytes": size,
        "payload_digest": digest, "refers_to": _urn_id(headers.get("warc-refers-to")), "payload": payload if kind == "response" else None,
    }


# frames


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, found from its block headers."""
    (magic,) = struct.unpack_from("<I", data, at)
    if magic in SKIPPABLE:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    elif magic == FRAME_MAGIC:
        checksum = data[at + 4] & 4
        end, last = at + zstandard.frame_header_size(bytes(data[at : at + 18])), False
        while not last:
            if end + 3 > len(data):
                raise WarcError("truncated frame")
            block = int.from_bytes(data[end : end + 3], "little")
            last = bool(block & 1)
            end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        end += 4 * bool(checksum)
    else:
        raise WarcError(f"no Zstandard frame at byte {at}: {magic:#x}")
    if end > len(data):
        raise WarcError("truncated frame")
    return end


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, decoded one frame at a time."""
    data, at, reader = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError("truncated frame")
        end = frame_end(data, at)
        (magic,) = struct.unpack_from("<I", data, at)
        if magic in SKIPPABLE:
            if at == 0 and magic == DICTIONARY_MAGIC:
                raw = bytes(data[8:end])
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be compressed itself
                    raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=64 << 20)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        else:
            with reader.stream_reader(io.BytesIO(data[at:end])) as stream:
                raw = stream.read()
            yield parse_record(raw)
        at = end


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample payloads; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


# DataFrames


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    same = large.groupBy("digest").agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = stage(same.select(F.col("digest").alias("same"), "keep_id"), "warc-same")
    if same.count() <= MAX_BROADCAST:
        same = F.broadcast(same)
    revisit = F.col("same").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep_id"))
    return rows.join(same, rows["digest"] == same["same"], "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keep_id")).alias("refers_to")
    )


def write(records: DataFrame, path: str, dictionary: bytes = b"", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives under ``path`` (a URI); returns the manifest: file, records, bytes."""
    small_batches(records.sparkSession, 128)

    def run(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root)
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **options)
        lead = dictionary_frame(dictionary) if dictionary else b""
        info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:warcinfo>"), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        parts, size, n = [], 0, 0

        def flush():
            name = f"{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(lead + packer.compress(info))
                for part in parts:
                    out.write(part)
            return pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                frame = packer.compress(page_record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["record_type"] == "revisit"))
                parts.append(frame)
                size, n = size + len(frame), n + 1
                if size >= archive_bytes:
                    yield flush()
                    parts, size, n = [], 0, 0
        if parts:
            yield flush()

    return stage(records.mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


_PAGE = "file string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_ARROW = pa.schema([
    ("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def read(spark, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """The page records of the archives under ``path``; with a manifest, only of those it names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.substring_index("path", "/", -1).alias("file"), "content")
    if manifest is not None:
        files = files.join(manifest.select("file"), "file", "left_semi")
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out, held = [], 0
                for headers, block in read_archive(content.as_py()):
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    out.append(read_page(headers, block) | {"file": name})
                    held += len(block)
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    small_batches(spark, 4)
    return files.mapInArrow(run, _PAGE)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", dictionary_chars: int = DICTIONARY_CHARS) -> DataFrame:
    """Write every page to archives in the shared folder and read the records back.

    The dictionary is trained on the first ``dictionary_chars`` of each of at most
    ``DICTIONARY_SAMPLE`` payloads; that bounds what the driver holds and changes the
    size of the archives, never what they hold.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    texts = pages.select(payload.alias("p")).where("p <> ''")
    share = min(1.0, 1.5 * DICTIONARY_SAMPLE / max(1, pages.count()))
    spot = F.pmod(F.xxhash64("p"), F.lit(1 << 20))
    sample = texts.where(spot < share * (1 << 20)).select(F.substring("p", 1, dictionary_chars).alias("p")).distinct().orderBy(F.xxhash64("p")).limit(DICTIONARY_SAMPLE)
    dictionary = train_dictionary([r["p"].encode() for r in sample.collect()])
    path = new_path(spark, "warc")
    manifest = write(with_revisits(pages, id_col, url_col, payload_col), path, dictionary)
    if manifest.isEmpty():
        return spark.createDataFrame([], _PAGE)
    return read(spark, path, manifest)
