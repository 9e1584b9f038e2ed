"""Scaling: epochs, splits, merges and their checks.  All tables here are metadata, a row per segment and epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.model import overlaps


def create(spark: SparkSession, n: int) -> DataFrame:
    """segment_id, key_start, key_end: n equal ranges, the last of which ends at 1.0."""
    i = F.col("id")
    return spark.range(n).select(i.alias("segment_id"), (i / F.lit(float(n))).alias("key_start"), F.when(i == n - 1, 1.0).otherwise((i + 1) / F.lit(float(n))).alias("key_end"))


def successors(epochs: DataFrame) -> DataFrame:
    """segment_id, successor: a segment that ends with an epoch and the new segments of the next one that overlap it."""
    now = epochs.select("epoch", "segment_id", "key_start", "key_end")
    nxt = epochs.select((F.col("epoch") - 1).alias("epoch"), F.col("segment_id").alias("successor"), F.col("key_start").alias("s"), F.col("key_end").alias("e"))
    ended = now.join(nxt.select("epoch", F.col("successor").alias("segment_id")), ["epoch", "segment_id"], "left_anti")
    fresh = nxt.join(now.select("epoch", F.col("segment_id").alias("successor")), ["epoch", "successor"], "left_anti")
    ended = ended.join(epochs.agg(F.max("epoch").alias("last")), F.col("epoch") < F.col("last"))
    return ended.join(fresh, "epoch").where(overlaps(F.col("key_start"), F.col("key_end"), F.col("s"), F.col("e"))).select("segment_id", "successor")


def successors_with_predecessors(links: DataFrame) -> DataFrame:
    """segment_id, successor, predecessors (all segments that must be read before the successor)."""
    every = links.groupBy("successor").agg(F.sort_array(F.collect_set("segment_id")).alias("predecessors"))
    return links.join(every, "successor").select("segment_id", "successor", "predecessors")


def split(segments: DataFrame, wanted: Column, factor: Column) -> DataFrame:
    """segment_id, part, key_start, key_end: equal parts; the last ends exactly where the segment does."""
    n = F.least(F.greatest(F.lit(2), wanted), F.greatest(F.lit(2), factor)).cast("int")
    cut = segments.withColumn("n", n).select("segment_id", "n", F.col("key_start").alias("a"), F.col("key_end").alias("b"), F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    width = (F.col("b") - F.col("a")) / F.col("n")
    end = F.when(F.col("part") == F.col("n") - 1, F.col("b")).otherwise(F.col("a") + width * (F.col("part") + 1))
    return cut.select("segment_id", "part", (F.col("a") + width * F.col("part")).alias("key_start"), end.alias("key_end"))


def merge_candidates(segments: DataFrame) -> DataFrame:
    """left_id, right_id, key_start, key_end of neighbours that are both cold (column ``cold``), leftmost pairs first,
    each segment in one pair at most: runs of cold neighbours are paired from their start."""
    w = Window.partitionBy("stream").orderBy("key_start")
    run = F.sum((~(F.col("cold") & F.coalesce(F.lag("cold").over(w), F.lit(False)))).cast("int")).over(w)
    placed = segments.withColumn("run", run)
    r = Window.partitionBy("stream", "run").orderBy("key_start")
    placed = placed.withColumn("k", F.row_number().over(r)).withColumn("right_id", F.lead("segment_id").over(r)).withColumn("right_end", F.lead("key_end").over(r))
    return placed.where("cold and k % 2 = 1 and right_id is not null").select("stream", F.col("segment_id").alias("left_id"), "right_id", "key_start", F.col("right_end").alias("key_end"))


def within_minimum(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Those merges, from the left, that leave a stream (stream, segments, least) its least number of segments."""
    k = F.row_number().over(Window.partitionBy("stream").orderBy("key_start"))
    return pairs.join(counts, "stream").withColumn("k", k).where(F.col("segments") - F.col("k") >= F.col("least")).drop("k", "segments", "least")


def islands(ranges: DataFrame, by: str) -> DataFrame:
    """Ranges of each ``by`` joined where one ends as the next begins."""
    w = Window.partitionBy(by).orderBy("key_start", "key_end")
    fresh = F.coalesce((F.col("key_start") > F.max("key_end").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    numbered = ranges.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    return numbered.groupBy(by, "island").agg(F.min("key_start").alias("key_start"), F.max("key_end").alias("key_end")).drop("island")


def validate(sealed: DataFrame, new: DataFrame) -> DataFrame:
    """scale_id, valid: the new ranges cover exactly what the sealed ones did, without lapping each other."""
    flat = lambda df, name: islands(df, "scale_id").groupBy("scale_id").agg(F.sort_array(F.collect_list(F.struct("key_start", "key_end"))).alias(name))
    w = Window.partitionBy("scale_id").orderBy("key_start", "key_end")
    lap = new.withColumn("lap", F.coalesce(F.lag("key_end").over(w) > F.col("key_start"), F.lit(False)) | (F.col("key_start") >= F.col("key_end")))
    laps = lap.groupBy("scale_id").agg(F.bool_or("lap").alias("laps"))
    got = flat(sealed, "x").join(flat(new, "y"), "scale_id", "left").join(laps, "scale_id", "left")
    return got.select("scale_id", (F.coalesce(F.col("x") == F.col("y"), F.lit(False)) & ~F.coalesce("laps", F.lit(True))).alias("valid"))


def next_epoch(epochs: DataFrame, sealed: list[int], ranges: list[tuple[float, float]]) -> DataFrame:
    """The epoch table with one more epoch: sealed segments out, new ones numbered on, id = epoch << 32 | number."""
    spark = epochs.sparkSession
    top = epochs.agg(F.max("epoch").alias("e"), F.max(F.col("segment_id").bitwiseAND(F.lit(0xFFFFFFFF))).alias("n"))
    last = epochs.join(top, F.col("epoch") == F.col("e")).where(~F.col("segment_id").isin(sealed)).select((F.col("e") + 1).cast("int").alias("epoch"), "segment_id", "key_start", "key_end")
    new = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(ranges)], "i long, key_start double, key_end double")
    made = new.join(F.broadcast(top)).select((F.col("e") + 1).cast("int").alias("epoch"), F.shiftleft((F.col("e") + 1).cast("long"), 32).bitwiseOR(F.col("n") + 1 + F.col("i")).alias("segment_id"), "key_start", "key_end")
    return epochs.select("epoch", "segment_id", "key_start", "key_end").unionByName(last).unionByName(made)


def replace_range(segments: DataFrame, sealed: int, links: DataFrame, ranges: DataFrame) -> DataFrame:
    """Active segments after ``sealed`` gave way to its successors, clipped to its range; equal neighbours join."""
    own = segments.where(F.col("segment_id") == sealed).select(F.col("key_start").alias("a"), F.col("key_end").alias("b"))
    to = links.where(F.col("segment_id") == sealed).select(F.col("successor").alias("segment_id")).join(ranges.select("segment_id", "key_start", "key_end"), "segment_id")
    clipped = to.join(own).select("segment_id", F.greatest("key_start", "a").alias("key_start"), F.least("key_end", "b").alias("key_end"))
    every = segments.where(F.col("segment_id") != sealed).select("segment_id", "key_start", "key_end").unionByName(clipped)
    return islands(every, "segment_id").select("segment_id", "key_start", "key_end")


def split_merge_counts(epochs: DataFrame) -> DataFrame:
    """epoch, splits, merges up to each epoch: segments of the epoch before that overlap several of this one, and the reverse."""
    now = epochs.select("epoch", F.col("segment_id").alias("n"), F.col("key_start").alias("ns"), F.col("key_end").alias("ne"))
    before = epochs.select((F.col("epoch") + 1).alias("epoch"), F.col("segment_id").alias("b"), F.col("key_start").alias("bs"), F.col("key_end").alias("be"))
    met = now.join(before, "epoch").where(overlaps(F.col("ns"), F.col("ne"), F.col("bs"), F.col("be")))
    several = lambda side, name: met.groupBy("epoch", side).count().where("count > 1").groupBy("epoch").agg(F.count("*").alias(name))
    up_to = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    each = epochs.select("epoch").distinct().join(several("b", "s"), "epoch", "left").join(several("n", "m"), "epoch", "left").na.fill(0)
    return each.select("epoch", F.sum("s").over(up_to).alias("splits"), F.sum("m").over(up_to).alias("merges"))


def at_head(epochs: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """segment_id, offset where the stream begins: the cut it was truncated at, else the segments of epoch 0 at 0."""
    return cut.select("segment_id", "offset") if cut is not None else epochs.where("epoch = 0").select("segment_id", F.lit(0).cast("long").alias("offset"))


def current(epochs: DataFrame) -> DataFrame:
    """The segments of the last epoch."""
    return epochs.join(epochs.agg(F.max("epoch").alias("epoch")), "epoch", "left_semi")
