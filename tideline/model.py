"""Schemas, and the epoch history that the test events are routed by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCHS = "epoch int, segment_id long, key_start double, key_end double"
CUT = "cut_id long, segment_id long, offset long"

#: Fixed values: (epoch, segment id, low, high]; the ids are epoch << 32 | number.
HISTORY = (
    (0, 0, 0.0, 0.5), (0, 1, 0.5, 1.0),
    (1, 4294967298, 0.0, 0.25), (1, 4294967299, 0.25, 0.5), (1, 1, 0.5, 1.0),
    (2, 4294967298, 0.0, 0.25), (2, 8589934596, 0.25, 1.0),
)
#: When each epoch became active.
STARTS = ((0, None), (1, "2024-01-11"), (2, "2024-01-21"))


def epochs(spark: SparkSession, history=HISTORY) -> DataFrame:
    """The epoch table: one row per epoch and segment, so it grows with scale events, not with data."""
    return spark.createDataFrame(list(history), EPOCHS)


def segments(spark: SparkSession, history=HISTORY) -> DataFrame:
    """Each segment once: its range, first epoch and last epoch."""
    return epochs(spark, history).groupBy("segment_id").agg(F.min("key_start").alias("key_start"), F.max("key_end").alias("key_end"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"))


def segment_epoch(segment_id):
    return F.shiftright(segment_id, 32).cast("int")


def segment_number(segment_id):
    return segment_id.bitwiseAND(F.lit(0xFFFFFFFF))


def segment_id(epoch, number):
    return F.shiftleft(epoch.cast("long"), 32).bitwiseOR(number.cast("long"))


def overlaps(a_start, a_end, b_start, b_end):
    """Open on both ends."""
    return (a_start < b_end) & (a_end > b_start)
