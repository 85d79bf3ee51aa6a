"""Structured Streaming: ingest of crawler lines, and metrics over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..sources.crawl import LINE

METRICS = "ts timestamp, ns string, duration long, bytes long"


def ingest_stream(spark: SparkSession, source: str, store: str, checkpoint: str) -> StreamingQuery:
    """Crawler files as they arrive, as paths under ``store``; ``stored_paths`` reads them, the newest line winning.

    Each batch writes its own paths alone, into a folder named by its number, so a batch that is run again after a
    failure writes the same folder again.
    """
    lines = spark.readStream.csv(source, schema=LINE, sep="\t", quote="\b")

    def keep(batch: DataFrame, number: int) -> None:
        staged = ingest.staged_paths(batch.withColumn("ingested", F.lit(number).cast("long")))
        staged.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return lines.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_paths(spark: SparkSession, store: str) -> DataFrame:
    """The newest line of each path of an ingest stream: one aggregation over its batches."""
    return ingest.latest(spark.read.parquet(store).drop("batch"), ["pa_hash"], "pa_ingested")


def compact(spark: SparkSession, store: str, path: str) -> None:
    """Write ``stored_paths`` to a new place, which a catalogue table can then be pointed at."""
    stored_paths(spark, store).write.mode("overwrite").parquet(path)


def metrics_windows(records: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests, bytes and mean duration per window and variable; records later than ``late`` are left out."""
    windows = records.withWatermark("ts", late).groupBy(F.window("ts", width), "ns")
    return windows.agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"), F.avg("duration").alias("duration"))


def metrics_stream(spark: SparkSession, source: str, store: str, checkpoint: str) -> StreamingQuery:
    """Metrics logs as they arrive, as windows in Parquet."""
    out = metrics_windows(spark.readStream.json(source, schema=METRICS))
    flat = out.select(F.col("window.start").alias("start"), "ns", "requests", "bytes", "duration")
    return flat.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
