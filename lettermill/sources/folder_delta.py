"""A streaming source of a remote folder's changes, page by page behind a watermark.

``spark.readStream.format("folder_delta").load(path)`` follows a log of changes, JSON
lines of sequence, operation (create, update, delete), item_id, subject and received.
A request returns at most ``maxChanges`` (100 at most) changes beyond the watermark and
the next watermark, which Spark keeps as the stream's offset: a restarted query goes on
where its checkpoint left off, and a page that is read again is the same page.  Pages
are small by contract and are fetched by the driver, like the remote calls they stand
for.  Lines that cannot be parsed raise; a log that does not exist yet has no changes.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "sequence long, operation string, item_id string, subject string, received string"
#: Fixed value: the most changes of one request.
MOST_CHANGES = 100


def changes_after(path: str, watermark: int, most: int | None = None) -> list[tuple]:
    """The changes of a log beyond a watermark, in order, at most ``most``."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as lines:
        rows = [json.loads(line) for line in lines if line.strip()]
    rows = sorted((r for r in rows if r["sequence"] > watermark), key=lambda r: r["sequence"])[:most]
    return [(r["sequence"], r["operation"], r["item_id"], r.get("subject"), r.get("received")) for r in rows]


class FolderDeltaReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path = options["path"].removeprefix("file://")
        self.most = min(MOST_CHANGES, max(1, int(options.get("maxchanges", MOST_CHANGES))))

    def initialOffset(self) -> dict:
        return {"watermark": 0}

    def read(self, start: dict):
        page = changes_after(self.path, start["watermark"], self.most)
        return iter(page), {"watermark": page[-1][0] if page else start["watermark"]}

    def readBetweenOffsets(self, start: dict, end: dict):
        return (row for row in changes_after(self.path, start["watermark"]) if row[0] <= end["watermark"])


class FolderDeltaSource(DataSource):
    @classmethod
    def name(cls):
        return "folder_delta"

    def schema(self):
        return SCHEMA

    def simpleStreamReader(self, schema):
        return FolderDeltaReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderDeltaSource)
