"""Structured Streaming forms of ingestion over the events table as a file stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.staging import shared_dir

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster shares."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str, per_batch: int = 4) -> DataFrame:
    """The events as a stream of files, of one schema that is never inferred; the glob takes a file as well as a folder of parts."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).parquet(f"{sf_dir}/events.parque[t]")


def first_of_each(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key; the state holds keys only."""
    return stream.select(*keys).dropDuplicates(keys)


def daily_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    grouped = timed.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    grouped = timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


def run_to_end(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a stream to the end of its input and return what it wrote.

    Each batch goes to a table of its own, overwritten if the batch runs again; in
    complete mode the last batch is the result.
    """
    path = shared_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        target = path if mode == "complete" else f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    started = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{shared_path(spark, name)}-log").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def upsert_to_end(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """(user_id, event_id, n): last event and count of each user, merged batch by batch.

    The stored table carries the batch it was made by; a batch that runs again
    merges into the version before it.
    """
    path = shared_path(spark, "upsert")
    kept: list[tuple[int, str]] = []

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))
        before = [p for n, p in kept if n < number]
        if before:
            new = spark.read.parquet(before[-1]).unionByName(new).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.sum("n").alias("n"))
        target = f"{path}/version={number}"
        new.write.mode("overwrite").parquet(target)
        kept[:] = [(n, p) for n, p in kept if n < number] + [(number, target)]

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(kept[-1][1])
