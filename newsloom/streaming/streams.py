"""Structured Streaming twins of the ingest, triage and classification operators."""

from __future__ import annotations

import uuid
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.articles import replay_events
from newsloom.operators.ingest import drop_stale, drop_unusable
from newsloom.operators.rules import decide
from newsloom.operators.tables import shared_folder


def landing(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over parquet files of a landing folder, of the schema that is there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def work_folder(spark: SparkSession) -> str:
    """A new folder for a stream's output and state, in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that has landed and returns its result; of complete mode, the last batch's."""
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").outputMode(mode)
    if mode == "append":
        writer.format("parquet").start(f"{folder}/out").awaitTermination()
    else:
        writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_items(items: DataFrame, as_of: Column, max_age_days: int = 30) -> DataFrame:
    return drop_stale(drop_unusable(items), as_of, max_age_days)


def stream_dedup(items: DataFrame, window: str = "30 days") -> DataFrame:
    """The first item of each url within the window; what comes later than the watermark is dropped."""
    return items.withWatermark("fetched_at", window).dropDuplicatesWithinWatermark(["url"])


def stream_classify(items: DataFrame, rules: list) -> DataFrame:
    """Rule decisions, item by item."""
    return decide(items, rules)


def stream_triage(events: DataFrame) -> DataFrame:
    """The latest status and star of every article, for complete or update mode."""
    return replay_events(events)
