"""Writing streams: routed, idempotent, large events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.hashing import route

#: Fixed value: the most bytes of one event, header included.
MAX_WRITE = (8 << 20) + 8


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """The log in files by segment, each sorted by offset, so scans between cuts prune folders and row groups."""
    log.repartition("segment_id", F.floor(F.col("event_id") / (1 << 20))).sortWithinPartitions("segment_id", "offset").write.partitionBy("segment_id").mode(mode).parquet(path)


def idempotent_batch(path: str, epochs: DataFrame):
    """A ``foreachBatch`` function: routes a micro-batch and writes it under its number, so a replay overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        route(batch, epochs).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def batches(events: DataFrame, key: str, batch: str, size: str, event_limit: int = MAX_WRITE, batch_limit: int = 2 * MAX_WRITE) -> DataFrame:
    """Events with ``result``, the same for all of a batch of a key, which is written whole or not at all.

    Ok, NoKey (null), NoEvent (one of the batch has no size), EventTooLarge or BatchTooLarge; sizes count headers.  A batch goes to one
    segment: ``epoch`` becomes the last one of its events."""
    sums = events.groupBy(key, batch).agg(F.sum(size).alias("__all"), F.max(size).alias("__top"), F.count_if(F.col(size).isNull()).alias("__none"), F.max("epoch").alias("__epoch"))
    result = F.when(F.col("__none") > 0, "NoEvent").when(F.col("__top") > event_limit, "EventTooLarge").when(F.col("__all") > batch_limit, "BatchTooLarge").otherwise("Ok")
    out = events.join(sums.select(key, batch, "__epoch", result.alias("result")), [key, batch], "left")
    return out.withColumns({"result": F.coalesce("result", F.lit("NoKey")), "epoch": F.coalesce("__epoch", "epoch")}).drop("__epoch")


def slices(df: DataFrame, key: str, payload: str, size: int) -> DataFrame:
    """Large events as rows (key, part, of, payload) of ``size`` bytes at most."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / size)).cast("int")
    cut = df.select(key, F.col(payload).alias("__p"), n.alias("of"), F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return cut.select(key, "part", "of", F.substring("__p", F.col("part") * size + 1, F.lit(size)).alias(payload))


def reassemble(parts: DataFrame, key: str, payload: str) -> DataFrame:
    """Events of which every part has come; the others wait."""
    got = parts.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("part", F.hex(payload).alias("p")))).alias("s"), F.max("of").alias("of")).where(F.size("s") == F.col("of"))
    return got.select(key, F.unhex(F.array_join(F.transform("s", lambda x: x["p"]), "")).alias(payload))
