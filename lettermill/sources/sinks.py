"""Sinks: guarded CSV, JSON lines, GraphML, and a table with its content hash."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_safe


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV whose cells no spreadsheet takes for formulas."""
    rows.select(*(csv_safe(F.col(c)).alias(c) for c in rows.columns)).write.mode("overwrite").csv(path, header=True, escape='"')


def write_training(triplets: DataFrame, path: str) -> None:
    """One ``{"query", "pos", "neg"}`` object a line."""
    triplets.select(F.col("query"), F.array("positive").alias("pos"), F.array("negative").alias("neg")).write.mode("overwrite").json(path)


def graphml_lines(edges: DataFrame) -> DataFrame:
    """The node and edge elements of a GraphML document, one a row."""
    attr = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))
    nodes = edges.select(F.explode(F.array("sender", "recipient")).alias("n")).distinct().select(F.lit(0).alias("part"), F.concat(F.lit("<node id="), attr("n"), F.lit("/>")).alias("line"))
    lines = edges.select(F.lit(1).alias("part"), F.concat(F.lit("<edge source="), attr("sender"), F.lit(" target="), attr("recipient"), F.lit("><data key=\"weight\">"), F.col("email_count"), F.lit("</data></edge>")).alias("line"))
    return nodes.union(lines)


def write_graphml(edges: DataFrame, path: str) -> None:
    """Streams the elements to one local file in order; edges are aggregated, and only one partition is held."""
    with open(path, "w", encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        out.write(f'<key id="weight" for="edge" attr.name={quoteattr("weight")} attr.type="long"/>\n<graph edgedefault="directed">\n')
        for row in graphml_lines(edges).orderBy("part", "line").toLocalIterator():
            out.write(row["line"] + "\n")
        out.write("</graph>\n</graphml>\n")


def with_content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Custody: a SHA-256 over the named columns."""
    return rows.withColumn("content_hash", F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256))


def reset_derived(spark: SparkSession, folder: str, derived: tuple[str, ...]) -> None:
    """Empty the named tables under ``folder`` and keep their schemas; what is not named, the messages above all, stays."""
    for name in derived:
        path = f"{folder.rstrip('/')}/{name}"
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
