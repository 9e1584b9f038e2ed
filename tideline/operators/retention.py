"""Retention: which recorded cut to truncate a stream at.  The retention set is metadata: a row per recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_records(records: DataFrame, delta: Column, least: int, most: int | None) -> DataFrame:
    """min_id: the record of least delta that still is ``least`` or more; max_id: of the greatest delta up to ``most``, else min_id."""
    d = records.withColumn("d", delta)
    ok = F.col("d") >= least
    top = ok & (F.col("d") <= most) if most is not None else F.lit(False)
    got = d.agg(F.min_by(F.when(ok, F.col("cut_id")), F.when(ok, F.col("d"))).alias("min_id"), F.max_by(F.when(top, F.col("cut_id")), F.when(top, F.col("d"))).alias("max_id"))
    return got.select("min_id", F.coalesce("max_id", "min_id").alias("max_id"))


def before_bound(records: DataFrame, orders: DataFrame) -> DataFrame:
    """before_id: the latest record that the bound is at or after; orders (cut_id, bound_vs_record)."""
    reached = records.join(orders, "cut_id").where(F.col("bound_vs_record") == "EqualOrAfter")
    return reached.agg(F.max_by("cut_id", "time").alias("before_id"))


def truncate_by_size(records: DataFrame, size: int, least: int, most: int | None, retained: int | None = None, orders: DataFrame | None = None) -> DataFrame:
    """choice: the id of the cut to truncate at, 'LB' for the subscribers' bound, or null.

    retained: bytes after the bound, None without subscribers; orders (cut_id, record_vs_bound, bound_vs_record)."""
    best = best_records(records, F.lit(size) - F.col("size"), least, most)
    if retained is None:
        return best.select(F.col("min_id").cast("string").alias("choice"))
    side = best.join(orders.select(F.col("cut_id").alias("min_id"), "record_vs_bound"), "min_id", "left").withColumn("before_id", F.lit(before_bound(records, orders).first()[0]).cast("long"))
    deltas = records.select(F.col("cut_id").alias("max_id"), (F.lit(size) - F.col("size")).alias("max_d"))
    side = side.join(deltas, "max_id", "left")
    few = F.when(F.col("min_id").isNull(), None).when(F.col("record_vs_bound") == "Before", F.col("min_id").cast("string")).otherwise(F.col("before_id").cast("string"))
    if retained < least:
        return side.select(few.alias("choice"))
    if most is None or retained < most:
        return side.select(F.lit("LB").alias("choice"))
    return side.select(F.when(F.col("max_d") < retained, F.col("max_id").cast("string")).otherwise("LB").alias("choice"))


def truncate_by_time(records: DataFrame, now: int, least: int, most: int | None, orders: DataFrame | None = None) -> DataFrame:
    """As by size, with age for size: the bound counts only between the records that are old enough and too old."""
    age = F.lit(now) - F.col("time")
    best = best_records(records, age, least, most)
    if orders is None:
        return best.select(F.col("min_id").cast("string").alias("choice"))
    old = records.where(age >= (most if most is not None else 1 << 62)).agg(F.max_by("cut_id", "time").alias("old_id"))
    pick = lambda c, v: orders.select(F.col("cut_id").alias(c), F.col(v).alias(f"{c}_{v}"))
    # one row each: ids, so the driver may hold them
    r = best.withColumn("old_id", F.lit(old.first()[0]).cast("long")).withColumn("before_id", F.lit(before_bound(records, orders).first()[0]).cast("long"))
    r = r.join(pick("min_id", "record_vs_bound"), "min_id", "left").join(pick("old_id", "bound_vs_record"), "old_id", "left")
    text = lambda c: F.col(c).cast("string")
    late = F.when(F.col("old_id").isNull() | (F.col("old_id_bound_vs_record") == "EqualOrAfter"), "LB").when(F.col("old_id_bound_vs_record") == "Before", text("max_id")).otherwise(text("old_id"))
    choice = F.when(F.col("min_id").isNull(), None).when(F.col("min_id_record_vs_bound") == "Before", text("min_id")).when(F.col("min_id_record_vs_bound") == "Overlaps", text("before_id")).otherwise(late)
    return r.select(choice.alias("choice"))


def truncate(log: DataFrame, cut: DataFrame, segments: DataFrame) -> DataFrame:
    """Events at or after a cut (segment_id, offset): of its segments from the offset, of later segments all."""
    from tideline.model import overlaps

    r = cut.join(segments, "segment_id").select(F.col("segment_id").alias("c"), F.col("key_start").alias("cs"), F.col("key_end").alias("ce"))
    s = segments.select("segment_id", "key_start", "key_end")
    gone = s.join(r, overlaps(F.col("key_start"), F.col("key_end"), F.col("cs"), F.col("ce")) & (F.col("segment_id") < F.col("c"))).select("segment_id").distinct()
    live = s.join(gone, "segment_id", "left_anti").join(cut.select("segment_id", F.col("offset").alias("head")), "segment_id", "left").select("segment_id", F.coalesce("head", F.lit(0)).alias("head"))
    return log.join(live, "segment_id").where(F.col("offset") >= F.col("head")).drop("head")


def consumed(groups: DataFrame, checkpoints: DataFrame, user_cuts: DataFrame) -> DataFrame:
    """The cuts that hold data back: groups (group_id, mode, cut ids checkpoint and user) -> cut_id (the group's id), segment_id, offset.

    mode automatic takes the group's last checkpoint, manual the cut its user gave; none, or a group without such a cut, holds nothing back."""
    take = lambda mode, column, cuts: groups.where(F.col("mode") == mode).select("group_id", F.col(column).alias("cut_id")).join(cuts, "cut_id").select(F.col("group_id").alias("cut_id"), "segment_id", "offset")
    return take("automatic", "checkpoint", checkpoints).unionByName(take("manual", "user", user_cuts))
