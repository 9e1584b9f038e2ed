"""Structured Streaming over the event files: windows, sessions, dedup, state.

Event times get a watermark only where state must be bounded, because the stream itself never drops late
events.  Each query runs once over what there is (``availableNow``); its batches are written under their
numbers, so a replayed batch overwrites itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.scratch import fresh
from tideline.streaming.state import running_counts


def source(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    raw = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path + "*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows the query emits over what its source holds now."""
    spark = stream.sparkSession
    root = fresh(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out/*")


def window_counts(stream: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = F.session_window("ts", gap)
    grouped = stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return grouped.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")


def deduplicated(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One event of each key within the watermark (idempotent producers resend)."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys).select(*keys)


def counts_by_key(stream: DataFrame, key: str) -> DataFrame:
    return running_counts(stream, key)
