"""Reader groups: assignment, progress, checkpoints, order across scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(assigned: DataFrame, readers: DataFrame) -> DataFrame:
    """reader, segments: how many each reader owns, those without any as well."""
    own = assigned.where("reader is not null").groupBy("reader").agg(F.count("*").alias("segments"))
    return readers.join(own, "reader", "left").select("reader", F.coalesce("segments", F.lit(0)).alias("segments"))


def to_acquire(owned, readers, total, unassigned):
    """Segments a reader may take: an even share of the unassigned, at least one while there are any."""
    fair = F.least(unassigned, F.round(total / readers).cast("long") - owned)
    return F.when(unassigned <= 0, 0).otherwise(F.greatest(F.floor(unassigned / readers), fair, F.lit(1)))


def should_release(owned, least, unassigned):
    return owned > least + F.greatest(F.lit(1), unassigned)


def plan(assigned: DataFrame, readers: DataFrame) -> DataFrame:
    """reader, segments, acquire, release."""
    c = counts(assigned, readers)
    free = assigned.agg(F.count(F.when(F.col("reader").isNull(), 1)).alias("free"), F.count("*").alias("total"))
    stats = c.agg(F.count("*").alias("n"), F.min("segments").alias("least"))
    j = c.crossJoin(F.broadcast(free)).crossJoin(F.broadcast(stats))  # one row each
    return j.select("reader", "segments", to_acquire(F.col("segments"), F.col("n"), F.col("total"), F.col("free")).cast("long").alias("acquire"), should_release(F.col("segments"), F.col("least"), F.col("free")).alias("release"))


def ranked(readers: DataFrame, assumed: int = 1) -> DataFrame:
    """readers (reader, segments, lag) -> relative size and rank, largest first.  Readers are metadata."""
    top = readers.agg(F.greatest(F.max("lag"), F.lit(assumed)).alias("top"))
    size = F.col("segments") * F.greatest(F.col("lag"), F.lit(assumed)) / F.col("top")
    sized = readers.crossJoin(F.broadcast(top)).select("reader", size.alias("size"))  # one row
    return sized.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "reader")))


def checkpoint(progress: DataFrame) -> DataFrame:
    """A checkpoint (name, segment_id, offset) from readers' positions: complete when no reader is missing.

    progress (name, reader, segment_id, offset; offset null: not reported)."""
    w = Window.partitionBy("name")
    done = progress.withColumn("complete", F.bool_and(F.col("offset").isNotNull()).over(w))
    return done.groupBy("name", "segment_id").agg(F.max("offset").alias("offset"), F.bool_and("complete").alias("complete"))


def admit(requests: DataFrame, outstanding: int = 3) -> DataFrame:
    """Checkpoint requests (name, seq, silent, done_seq) -> admitted: at most ``outstanding`` open ones, silent ones apart."""
    o = requests.select(F.col("seq").alias("o_seq"), F.col("done_seq").alias("o_done"), F.col("silent").alias("o_silent"))
    r = requests.join(F.broadcast(o), (F.col("o_seq") < F.col("seq")) & (F.col("o_done") > F.col("seq")) & ~F.col("o_silent"), "left")
    return r.groupBy("name", "seq", "silent").agg(F.count("o_seq").alias("open")).select("name", "seq", (F.col("silent") | (F.col("open") < outstanding)).alias("admitted"))


def start_times(done: DataFrame, links: DataFrame) -> DataFrame:
    """successor, ready_at: when all its predecessors were read to the end (null: not yet); done (segment_id, done_at)."""
    j = links.join(done, "segment_id", "left")
    return j.groupBy("successor").agg(F.when(F.bool_and(F.col("done_at").isNotNull()), F.max("done_at")).alias("ready_at"))


def segment_to_release(assigned: DataFrame) -> DataFrame:
    """reader, segment_id: of a reader's segments that of greatest hash, seeded by the reader, so readers differ in choice."""
    return assigned.where("reader is not null").groupBy("reader").agg(F.max_by("segment_id", F.struct(F.xxhash64("reader", "segment_id"), "segment_id")).alias("segment_id"))


def restart(log: DataFrame, positions: DataFrame) -> DataFrame:
    """What a group reads after a reset to a cut (segment_id, offset): events at or after it in its segments."""
    at = positions.select(F.col("segment_id"), F.col("offset").alias("__from"))
    return log.join(F.broadcast(at), "segment_id").where(F.col("offset") >= F.col("__from")).drop("__from")


def offline_positions(assigned: DataFrame, reported: DataFrame) -> DataFrame:
    """Where a dead reader's segments go on: its last reported offset, else the one they were assigned at."""
    r = reported.select("reader", "segment_id", F.col("offset").alias("__o"))
    return assigned.join(r, ["reader", "segment_id"], "left").select("segment_id", F.coalesce("__o", "offset").alias("offset"))
