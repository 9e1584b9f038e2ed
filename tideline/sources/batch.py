"""Bounded reads: segment ranges between cuts, pointers, byte ranges; and a data source over segment ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tideline import model
from tideline.operators import cuts as C
from tideline.sources.events import prefix_sum

UNBOUNDED = None


def segment_ranges(spark: SparkSession, from_cut: dict[int, int] | None, to_cut: dict[int, int] | None, segments: DataFrame | None = None) -> DataFrame:
    """segment_id, start, stop (null: to the end): what lies between two cuts; None is the head or the tail."""
    segments = model.segments(spark) if segments is None else segments
    rows = [(k, int(s), int(o)) for k, cut in ((0, from_cut), (1, to_cut)) if cut for s, o in cut.items()]
    cuts = spark.createDataFrame(rows, model.CUT)
    pair = spark.createDataFrame([(0 if from_cut else None, 1 if to_cut else None)], "a long, b long")
    side = lambda k, name: cuts.where(F.col("cut_id") == k).select("segment_id", F.col("offset").alias(name))
    got = C.between(cuts, segments, pair).select("segment_id").join(side(0, "start"), "segment_id", "left").join(side(1, "stop"), "segment_id", "left")
    # a start of -1 means not reached yet, a stop of -1 means that nothing of the segment is read
    return got.select("segment_id", F.greatest(F.coalesce("start", F.lit(0)), F.lit(0)).alias("start"), F.when(F.col("stop").isNotNull(), F.greatest("stop", F.lit(0))).alias("stop"))


def scan(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """The events of ``log`` in [start, stop); ranges are metadata, a row per segment."""
    r = F.broadcast(ranges.select(F.col("segment_id").alias("__s"), "start", "stop"))
    inside = (F.col("offset") >= F.col("start")) & (F.col("stop").isNull() | (F.col("offset") < F.col("stop")))
    return log.join(r, (F.col("segment_id") == F.col("__s")) & inside, "left_semi")


def check_not_truncated(ranges: DataFrame, heads: DataFrame) -> DataFrame:
    """Ranges that begin before their segment's head (segment_id, head): reading them is an error."""
    return ranges.join(heads, "segment_id").where("start < head")


def fetch(log: DataFrame, pointers: DataFrame) -> DataFrame:
    """The events at pointers (segment_id, offset); a pointer to no event gives no row."""
    return pointers.join(log, ["segment_id", "offset"])


class TruncatedData(ValueError):
    """What was asked for lies before the head of its segment."""


def read_revisions(log: DataFrame, start: int | DataFrame, stop: int | None = None, heads: DataFrame | None = None) -> DataFrame:
    """Entries of each segment from revision ``start`` on (a number, or segment_id and start), before ``stop``: the log with revision and next_revision.

    A revision is the offset of an entry.  heads (segment_id, head): segments of which something was truncated; a start before the head raises ``TruncatedData``."""
    if heads is not None:
        asked = heads.withColumn("start", F.lit(start).cast("long")) if isinstance(start, int) else start
        if not check_not_truncated(asked.select("segment_id", "start"), heads.select("segment_id", "head")).isEmpty():
            raise TruncatedData("a start is before its segment's head")
    some = log.where(F.col("offset") >= start) if isinstance(start, int) else log.join(start.select("segment_id", "start"), "segment_id").where(F.col("offset") >= F.col("start")).drop("start")
    some = some if stop is None else some.where(F.col("offset") < stop)
    return some.withColumn("revision", F.col("offset")).withColumn("next_revision", F.col("offset") + F.col("len"))


def byte_range(log: DataFrame, start: int, length: int) -> DataFrame:
    """Events wholly inside [start, start + length) of each segment."""
    return log.where((F.col("offset") >= start) & (F.col("offset") + F.col("len") <= start + length))


def stream_info(log: DataFrame, segments: DataFrame) -> DataFrame:
    """segment_id, head, tail, sealed."""
    ends = log.groupBy("segment_id").agg(F.min("offset").alias("head"), F.max(F.col("offset") + F.col("len")).alias("tail"))
    last = segments.agg(F.max("last_epoch")).first()[0]
    return ends.join(F.broadcast(segments.select("segment_id", (F.col("last_epoch") < last).alias("sealed"))), "segment_id")


def round_robin(log: DataFrame) -> DataFrame:
    """Adds place, the order in which one reader takes turns over its segments."""
    # in buckets of offsets, so that a hot segment isn't one task's window
    ranked = prefix_sum(log.withColumn("__one", F.lit(1)), ["segment_id"], "offset", "__one", "turn").drop("__one").withColumn("turn", F.col("turn") + 1)
    counts = ranked.groupBy("turn").agg(F.count("*").alias("n"))
    # places of earlier turns: a turn has as many events as segments reach it
    before = counts.withColumn("b", F.floor(F.col("turn") / 4096))
    w = Window.partitionBy("b").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    base = before.groupBy("b").agg(F.sum("n").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = before.withColumn("inner", F.coalesce(F.sum("n").over(w), F.lit(0))).join(base.select("b", "base"), "b").select("turn", (F.col("inner") + F.col("base")).alias("start"))
    own = F.row_number().over(Window.partitionBy("turn").orderBy("segment_id")) - 1
    return ranked.join(starts, "turn").withColumn("place", (F.col("start") + own).cast("long"))


def union_streams(streams: dict[str, DataFrame]) -> DataFrame:
    """Several streams read together, with their name in ``stream``."""
    parts = [df.select(F.lit(name).alias("stream"), "*") for name, df in streams.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def concat(target: DataFrame, source: DataFrame) -> DataFrame:
    """The source segment appended to the target: its offsets move on by the target's length."""
    end = target.agg(F.coalesce(F.max(F.col("offset") + F.col("len")), F.lit(0)).alias("__end"))
    moved = source.crossJoin(F.broadcast(end)).withColumn("offset", F.col("offset") + F.col("__end")).drop("__end")  # one row
    return target.unionByName(moved)


def search(log: DataFrame, targets: DataFrame) -> DataFrame:
    """segment_id, target, at_or_after, at_or_before: event ends next to each target."""
    ends = log.select("segment_id", (F.col("offset") + F.col("len")).alias("end"))
    each = ends.select("segment_id", "end", F.explode(F.lit([r[0] for r in targets.collect()])).alias("target"))
    return each.groupBy("segment_id", "target").agg(F.min(F.when(F.col("end") >= F.col("target"), F.col("end"))).alias("at_or_after"), F.max(F.when(F.col("end") <= F.col("target"), F.col("end"))).alias("at_or_before"))


class _Range(InputPartition):
    def __init__(self, segment: int, start: int, stop: int | None):
        self.segment, self.start, self.stop = segment, start, stop


class SegmentSource(DataSource):
    """``spark.read.format("segments")`` over a written log partitioned by segment_id.

    Options: ``path``, and ``ranges`` as ``segment:start:stop`` items joined by commas (stop may be empty).
    Each range is one partition."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return "segment_id long, offset long, len long, event_id long, props string"

    def reader(self, schema) -> DataSourceReader:
        return _SegmentReader(self.options)


class _SegmentReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.ranges = options["path"], options["ranges"]

    def partitions(self):
        out = []
        for item in self.ranges.split(","):
            segment, start, stop = item.split(":")
            out.append(_Range(int(segment), int(start), int(stop) if stop else None))
        return out

    def read(self, partition):
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        at = ds.field("offset") >= partition.start
        if partition.stop is not None:
            at &= ds.field("offset") < partition.stop
        table = ds.dataset(f"{self.path}/segment_id={partition.segment}", format="parquet").to_table(columns=["offset", "len", "event_id", "props"], filter=at)
        table = table.take(pc.sort_indices(table, [("offset", "ascending")]))
        import pyarrow as pa

        for b in table.add_column(0, "segment_id", [pa.array([partition.segment] * len(table), pa.int64())]).to_batches():
            yield b
