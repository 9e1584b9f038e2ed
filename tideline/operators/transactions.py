"""Transactions: status, commit order, visibility, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH = 100
#: Allowed next states of a transaction.
MOVES = {"OPEN": ("COMMITTING", "ABORTING"), "COMMITTING": ("COMMITTED",), "ABORTING": ("ABORTED",), "COMMITTED": (), "ABORTED": ()}


def txn_id(epoch, low):
    """msb of the id: epoch in its upper half."""
    return F.shiftleft(epoch.cast("long"), 32).bitwiseOR(low)


def status(changes: DataFrame) -> DataFrame:
    """txn_id, status: the last of each transaction's changes (txn_id, seq, status)."""
    return changes.groupBy("txn_id").agg(F.max_by("status", "seq").alias("status"))


def illegal(changes: DataFrame) -> DataFrame:
    """Changes that the status machine doesn't allow."""
    w = Window.partitionBy("txn_id").orderBy("seq")
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, to in MOVES.items() for b in to))
    step = F.concat_ws(">", F.coalesce(F.lag("status").over(w), F.lit("")), "status")
    return changes.withColumn("step", step).where(~F.array_contains(allowed, F.col("step")) & (F.col("step") != ">OPEN")).drop("step")


def expired(txns: DataFrame, now: int, longest: int = 86_400_000) -> DataFrame:
    """Open transactions whose lease, or longest life of min(1000 leases, ``longest``), has run out."""
    life = F.least(1000 * F.col("lease"), F.lit(longest))
    return txns.where((F.col("status") == "OPEN") & ((F.lit(now) > F.col("pinged") + F.col("lease")) | (F.lit(now) > F.col("created") + life)))


def commit_batch(txns: DataFrame, limit: int = BATCH) -> DataFrame:
    """The next to commit: of the lowest epoch, in commit order, ``limit`` at most."""
    waiting = txns.where("status = 'COMMITTING'")
    low = waiting.agg(F.min("epoch").alias("low"))
    return waiting.join(F.broadcast(low), F.col("epoch") == F.col("low")).drop("low").orderBy("commit_order").limit(limit)


def visible(rows: DataFrame, txns: DataFrame) -> DataFrame:
    """Rows without a transaction, and those of committed ones."""
    done = txns.where("status = 'COMMITTED'").select(F.col("txn_id").alias("__t"))
    return rows.where("txn_id is null").unionByName(rows.join(done, F.col("txn_id") == F.col("__t"), "left_semi"))


def merge_offsets(rows: DataFrame, txns: DataFrame, base: DataFrame) -> DataFrame:
    """txn_id, segment_id, start, bytes: each committed transaction is one region of a segment, in commit order behind ``base``."""
    done = txns.where("status = 'COMMITTED'").select("txn_id", "epoch", "commit_order")
    each = rows.join(done, "txn_id").groupBy("segment_id", "txn_id", "epoch", "commit_order").agg(F.sum("len").alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("segment_id").orderBy("epoch", "commit_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("before", before).join(base, "segment_id", "left").select("txn_id", "segment_id", (F.coalesce("tail", F.lit(0)) + F.col("before")).cast("long").alias("start"), "bytes")


def rolling(epochs: DataFrame, txn_epoch: int) -> DataFrame:
    """The epoch table after a commit of an older epoch: its segments again as epoch + 1, the active ones as epoch + 2."""
    top = epochs.agg(F.max("epoch").alias("top"))
    number = F.col("segment_id").bitwiseAND(F.lit(0xFFFFFFFF))

    def again(which, shift: int) -> DataFrame:
        e = (F.col("top") + shift).cast("int")
        return epochs.crossJoin(F.broadcast(top)).where(which).select(e.alias("epoch"), F.shiftleft(e.cast("long"), 32).bitwiseOR(number).alias("segment_id"), "key_start", "key_end")  # top is one row

    own = epochs.select("epoch", "segment_id", "key_start", "key_end")
    return own.unionByName(again(F.col("epoch") == txn_epoch, 1)).unionByName(again(F.col("epoch") == F.col("top"), 2))


def completed(txns: DataFrame, n: int = 500) -> DataFrame:
    """The most recent transactions that ended."""
    return txns.where("status in ('COMMITTED', 'ABORTED')").orderBy(F.desc("ended"), "txn_id").limit(n)
