"""The test events as a stream: routed, framed and with offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.hashing import fraction, route
from tideline.model import STARTS, epochs

HEADER = 8
#: Ids that one task numbers; buckets keep a hot segment from being one task's work.
RUN = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def epoch_at(ts: Column, starts=STARTS) -> Column:
    """As-of lookup in the epoch history, which is metadata: one comparison per epoch, no join."""
    out = F.lit(starts[0][0])
    for epoch, start in starts[1:]:
        out = F.when(ts >= F.to_timestamp_ntz(F.lit(f"{start} 00:00:00")), epoch).otherwise(out)
    return out


def prefix_sum(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before, per key in ``order`` (a unique whole number).

    Sums run within buckets of ``RUN`` ids; sums of whole buckets, a small table, are put on top."""
    bucketed = df.withColumn("__b", F.floor(F.col(order) / RUN))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = bucketed.groupBy(*keys, "__b").agg(F.sum(value).alias("__s")).select(*keys, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = bucketed.withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(base, [*keys, "__b"]).withColumn(name, (F.col(name) + F.col("__base")).cast("long")).drop("__b", "__base")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, routing_key, writer_id, len, frac, epoch and segment_id, without offsets."""
    raw = read(spark, sf_dir, "events")
    framed = raw.select(
        "event_id", "ts", "user_id", "event_type", "value", "props", F.col("user_id").cast("string").alias("routing_key"), (F.col("user_id") % 4).cast("int").alias("writer_id"),
        (F.octet_length("props") + HEADER).cast("long").alias("len"), fraction(F.col("user_id").cast("string")).alias("frac"), epoch_at(F.col("ts")).alias("epoch"),
    )
    return route(framed, epochs(spark))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with offset: bytes before the event in its segment."""
    return prefix_sum(events(spark, sf_dir), ["segment_id"], "event_id", "len", "offset")
