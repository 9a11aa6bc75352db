"""A Python data source for mail archives: zip files of message XML members.

``spark.read.format("mail_zip").load("folder/*.olm")`` lists the members of every
archive on the driver, splits them into ranges of ``membersPerPartition``, and
parses on the executors.  Budgets bound what one archive can cost: its first
``maxMembers`` members, its first ``maxBytes`` bytes in all, ``maxMemberBytes`` each.
They are counted along the whole archive before it is split; what exceeds them, or
cannot be parsed, is returned with an error and no message.  Archives must lie where
the driver and every executor can open them by path, on a mounted shared folder.
"""

from __future__ import annotations

import glob
import zipfile
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "archive string, member string, message_id string, subject string, sent string, body string, html string, sender string, sender_name string, recipients array<string>, "
    "cc array<string>, in_reply_to string, attachments array<string>, error string"
)
# Where messages lie in an archive, and its budgets.
MESSAGE_FOLDER = "com.microsoft.__messages"
BUDGETS = {"maxMembers": 500_000, "maxBytes": 20 << 30, "maxMemberBytes": 50 << 20}


class _Range(InputPartition):
    def __init__(self, path: str, members: list[tuple[str, bool]]):
        self.path, self.members = path, members  # (name, within the budgets)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _people(node) -> list[tuple[str, str]]:
    """(address, name) pairs of an address list, from attributes first, then from child elements."""
    out = []
    for item in node.iter():
        values = {_local(k).lower(): v.strip() for k, v in item.attrib.items()} | {_local(c.tag).lower(): (c.text or "").strip() for c in item if len(c) == 0 and c.text}
        address = next((v for k, v in values.items() if k.endswith("address") and v), "")
        name = next((v for k, v in values.items() if k.endswith("name") and v), "")
        if address or name:
            out.append((address, name))
    return list(dict.fromkeys(out))


def parse_message(raw: bytes) -> dict:
    """The fields of one message; header fields by the end of their element's name."""
    root = ElementTree.fromstring(raw)
    found: dict = {}
    for node in root.iter():
        name = _local(node.tag)
        found.setdefault(name.removeprefix("OPFMessageCopy"), node)
    text = lambda key: ((found[key].text or "").strip() if key in found else "")
    people = lambda key: _people(found[key]) if key in found else []
    sender = (people("SenderAddress") or people("FromAddresses") or [("", "")])[0]
    names = [a.attrib.get("OPFAttachmentName") or a.attrib.get("name") or "" for a in (found["AttachmentList"].iter() if "AttachmentList" in found else [])]
    return {
        "message_id": text("MessageID").strip("<>"), "subject": text("Subject"), "sent": text("SentTime"), "body": text("Body"), "html": text("HTMLBody"), "sender": sender[0].lower(),
        "sender_name": sender[1], "recipients": [a.lower() for a, _ in people("ToAddresses")], "cc": [a.lower() for a, _ in people("CCAddresses")], "in_reply_to": text("InReplyTo").strip("<>"),
        "attachments": [n for n in names if n],
    }


class MailZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.limit = {k: int(self.options.get(k.lower(), v)) for k, v in BUDGETS.items()}

    def partitions(self):
        size = int(self.options.get("membersperpartition", 500))
        out = []
        for path in sorted(glob.glob(self.options["path"].removeprefix("file://"))):
            with zipfile.ZipFile(path) as archive:
                found = [i for i in archive.infolist() if i.filename.lower().endswith(".xml") and MESSAGE_FOLDER in i.filename.lower()]
            names, spent = [], 0
            for place, info in enumerate(found):
                fits = place < self.limit["maxMembers"] and info.file_size <= self.limit["maxMemberBytes"] and spent + info.file_size <= self.limit["maxBytes"]
                spent += info.file_size if fits else 0
                names.append((info.filename, fits))
            out += [_Range(path, names[k : k + size]) for k in range(0, len(names), size)]
        return out or [_Range("", [])]

    def read(self, partition):
        if not partition.path:
            return
        with zipfile.ZipFile(partition.path) as archive:
            for name, fits in partition.members:
                row, error = {}, None if fits else "over budget"
                if fits:
                    try:
                        row = parse_message(archive.read(name))
                    except (ElementTree.ParseError, NotImplementedError, RuntimeError, zipfile.BadZipFile) as problem:
                        error = f"{type(problem).__name__}: {problem}"[:200]
                yield (
                    partition.path, name, row.get("message_id"), row.get("subject"), row.get("sent"), row.get("body"), row.get("html"), row.get("sender"), row.get("sender_name"),
                    row.get("recipients"), row.get("cc"), row.get("in_reply_to"), row.get("attachments"), error,
                )


class MailZipSource(DataSource):
    @classmethod
    def name(cls):
        return "mail_zip"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MailZipReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MailZipSource)
