"""Stream cuts: positions over a whole key space.  A cut is rows (cut_id, segment_id, offset).

Cuts and segments are metadata - a few rows a cut - so overlap joins are over small tables; the event log
takes part only where sizes or boundaries are read from it, always with equality on segment_id first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.model import overlaps


def _ranged(cuts: DataFrame, segments: DataFrame) -> DataFrame:
    return cuts.join(segments.select("segment_id", "key_start", "key_end"), "segment_id")


def _side(df: DataFrame, p: str) -> DataFrame:
    return df.select(F.col("cut_id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("segment_id", "offset", "key_start", "key_end")))


def compare(cuts: DataFrame, segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) of cut ids -> a, b, ordering of a by b: Before, EqualOrAfter or Overlaps.

    Cuts form a lattice: overlapping segments are compared by offset if they are the same, else by id."""
    r = _ranged(cuts, segments)
    both = pairs.join(_side(r, "a"), "a").join(_side(r, "b"), "b").where(overlaps(F.col("a_key_start"), F.col("a_key_end"), F.col("b_key_start"), F.col("b_key_end")))
    same = F.col("a_segment_id") == F.col("b_segment_id")
    more = F.when(same, F.col("a_offset") > F.col("b_offset")).otherwise(F.col("a_segment_id") > F.col("b_segment_id"))
    less = F.when(same, F.col("a_offset") < F.col("b_offset")).otherwise(F.col("a_segment_id") < F.col("b_segment_id"))
    name = F.when(~F.bool_or(less), "EqualOrAfter").when(~F.bool_or(more), "Before").otherwise("Overlaps")
    return both.groupBy("a", "b").agg(name.alias("ordering"))


def between(cuts: DataFrame, segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) -> a, b, segment_id: segments at or after a and at or before b (b null: the tail)."""
    r = _ranged(cuts, segments)
    s = segments.select("segment_id", "key_start", "key_end")

    def blocked(p: str, off):
        side = pairs.select("a", "b").join(_side(r, p), p)
        hit = side.join(F.broadcast(s), overlaps(F.col("key_start"), F.col("key_end"), F.col(f"{p}_key_start"), F.col(f"{p}_key_end"))).where(off)
        return hit.select("a", "b", "segment_id").distinct()

    early = blocked("a", F.col("segment_id") < F.col("a_segment_id"))
    late = blocked("b", F.col("segment_id") > F.col("b_segment_id"))
    every = pairs.select("a", "b", F.explode(F.lit([r["segment_id"] for r in s.select("segment_id").collect()])).alias("segment_id"))
    on = lambda x, y: (x["a"].eqNullSafe(y["a"])) & (x["b"].eqNullSafe(y["b"])) & (x["segment_id"] == y["segment_id"])
    return every.join(early, on(every, early), "left_anti").join(late, on(every, late), "left_anti")


def spans(cuts: DataFrame, segments: DataFrame, sizes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, segment_id, from_offset, to_offset of what lies between; sizes (segment_id, bytes) end segments passed."""
    side = lambda p: cuts.select(F.col("cut_id").alias(p), "segment_id", F.greatest("offset", F.lit(0)).alias(f"{p}_offset"))
    got = between(cuts, segments, pairs).join(side("a"), ["a", "segment_id"], "left").join(side("b"), ["b", "segment_id"], "left").join(sizes, "segment_id", "left")
    return got.select("a", "b", "segment_id", F.coalesce("a_offset", F.lit(0)).cast("long").alias("from_offset"), F.coalesce("b_offset", "bytes", F.lit(0)).cast("long").alias("to_offset"))


def distance(cuts: DataFrame, segments: DataFrame, sizes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, n_segments, bytes between two cuts (the unread bytes of a reader at a with its end at b)."""
    return spans(cuts, segments, sizes, pairs).groupBy("a", "b").agg(F.count("*").alias("n_segments"), F.sum(F.col("to_offset") - F.col("from_offset")).alias("bytes"))


def validity(cuts: DataFrame, segments: DataFrame) -> DataFrame:
    """cut_id, gaps, laps, valid: a valid cut covers the key space once."""
    w = Window.partitionBy("cut_id").orderBy("key_start", "key_end")
    before = F.coalesce(F.lag("key_end").over(w), F.lit(0.0))
    steps = _ranged(cuts, segments).select("cut_id", "key_end", (F.col("key_start") > before).cast("long").alias("gap"), (F.col("key_start") < before).cast("long").alias("lap"))
    out = steps.groupBy("cut_id").agg((F.sum("gap") + (F.max("key_end") < 1.0).cast("long")).alias("gaps"), F.sum("lap").alias("laps"))
    return out.withColumn("valid", (F.col("gaps") == 0) & (F.col("laps") == 0))


def fully_valid(cuts: DataFrame, history) -> DataFrame:
    """cut_id, valid; an offset under 0 is a future segment: one that the reader is due to reach and hasn't begun.

    Valid if present segments cover no key twice; if whatever they leave open is covered by future segments, which are later than all present ones that they
    overlap; and if the open ranges can be followed, epoch by epoch, from the oldest epoch to future segments without passing one that a present
    segment should have come before.  A cut is a few rows, so each is judged in one group; ``history`` (epoch, segment_id, low, high) is metadata."""
    ranges = {s: (a, b) for _, s, a, b in history}
    by_epoch: dict[int, list[int]] = {}
    for e, s, *_ in history:
        by_epoch.setdefault(e, []).append(s)

    def meet(x: tuple[float, float], y: tuple[float, float]) -> bool:
        return x[0] < y[1] and x[1] > y[0]

    def judge(offsets: dict[int, int]) -> bool:
        if not offsets or any(s not in ranges for s in offsets):
            return False
        due = {s for s, o in offsets.items() if o < 0}
        present = set(offsets) - due
        if any(meet(ranges[f], ranges[s]) and s >= f for f in due for s in present):
            return False
        open_, at = [], 0.0
        for a, b in sorted(ranges[s] for s in present):
            if a < at:
                return False
            if a > at:
                open_.append((at, a))
            at = b
        if at < 1.0:
            open_.append((at, 1.0))
        if not all(any(meet(ranges[f], gap) for f in due) for gap in open_):
            return False
        oldest, newest = min(offsets) >> 32, max(offsets) >> 32
        seen, ahead = set(), [s for s in by_epoch[oldest] if any(meet(ranges[s], gap) for gap in open_)]
        while ahead:
            s = ahead.pop()
            if s in seen or s in offsets:
                continue
            seen.add(s)
            over = [p for p in present if meet(ranges[p], ranges[s])]
            if any(p < s for p in over):
                return False
            if over:  # read to its end: on to what came after it
                later = next((e for e in range(s >> 32, newest + 1) if s not in by_epoch[e]), None)
                ahead += [n for n in by_epoch[later] if meet(ranges[n], ranges[s])] if later is not None else []
        return True

    def run(table: pa.Table) -> pa.Table:
        valid = judge(dict(zip(table.column("segment_id").to_pylist(), table.column("offset").to_pylist(), strict=True)))
        return pa.table({"cut_id": table.column("cut_id").slice(0, 1), "valid": pa.array([valid])})

    return cuts.groupBy("cut_id").applyInArrow(run, "cut_id long, valid boolean")


def span_epochs(cuts: DataFrame, epochs: DataFrame) -> DataFrame:
    """cut_id, segment_id, epoch: the highest epoch, within those of the cut's oldest and newest segment, that has the segment."""
    ends = cuts.groupBy("cut_id").agg(F.shiftright(F.min("segment_id"), 32).cast("int").alias("lo"), F.shiftright(F.max("segment_id"), 32).cast("int").alias("hi"))
    got = cuts.join(ends, "cut_id").join(epochs.select("epoch", "segment_id"), "segment_id").where(F.col("epoch").between(F.col("lo"), F.col("hi")))
    return got.groupBy("cut_id", "segment_id").agg(F.max("epoch").alias("epoch"))


def upper_bound(cuts: DataFrame, segments: DataFrame) -> DataFrame:
    """Least upper bound of positions: greatest offset by segment, without segments that a later one overlaps."""
    best = cuts.groupBy("segment_id").agg(F.max("offset").alias("offset"))
    return _bound(best, segments, lambda later, own: later > own)


def lower_bound(cuts: DataFrame, segments: DataFrame) -> DataFrame:
    """Greatest lower bound: least offset by segment, without segments that an earlier one overlaps.

    A segment not reached (offset under 0) stays unless earlier ones in the bound cover all of its range."""
    best = cuts.groupBy("segment_id").agg(F.min("offset").alias("offset"))
    present = _bound(best.where("offset >= 0"), segments, lambda other, own: other < own)
    r = _ranged(best.where("offset < 0").withColumn("cut_id", F.lit(0)), segments)
    p = _ranged(present.withColumn("cut_id", F.lit(0)), segments).select(F.col("segment_id").alias("o"), F.col("key_start").alias("os"), F.col("key_end").alias("oe"))
    early = r.select(F.col("segment_id").alias("o"), F.col("key_start").alias("os"), F.col("key_end").alias("oe")).unionByName(p)
    hit = overlaps(F.col("key_start"), F.col("key_end"), F.col("os"), F.col("oe")) & (F.col("o") < F.col("segment_id"))
    parts = r.join(F.broadcast(early), hit).select("segment_id", "offset", "key_start", "key_end", F.greatest("os", "key_start").alias("s"), F.least("oe", "key_end").alias("e"))
    w = Window.partitionBy("segment_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    gap = (F.col("s") > F.coalesce(F.max("e").over(w), F.col("key_start"))).cast("int")
    covered = parts.withColumn("gap", gap).groupBy("segment_id").agg(((F.sum("gap") == 0) & (F.max("e") >= F.max("key_end"))).alias("covered")).where("covered")
    return present.unionByName(r.join(covered, "segment_id", "left_anti").select("segment_id", "offset"))


def _bound(best: DataFrame, segments: DataFrame, passes) -> DataFrame:
    r = best.join(segments.select("segment_id", "key_start", "key_end"), "segment_id")
    o = r.select(F.col("segment_id").alias("o"), F.col("key_start").alias("os"), F.col("key_end").alias("oe"))
    hit = overlaps(F.col("key_start"), F.col("key_end"), F.col("os"), F.col("oe")) & passes(F.col("o"), F.col("segment_id"))
    return r.join(F.broadcast(o), hit, "left_anti").select("segment_id", "offset")


def next_cut(cuts: DataFrame, log: DataFrame, sizes: DataFrame, links: DataFrame, approx: int) -> DataFrame:
    """Each cut moved on by about ``approx`` bytes, dealt evenly to its segments, to event boundaries.

    links (segment_id, successor).  A cut that can't move gives its finished segments to those successors of which
    no predecessor in the cut is unread; they start at 0."""
    n = F.count("*").over(Window.partitionBy("cut_id"))
    target = cuts.withColumn("target", F.col("offset") + F.greatest(F.lit(1), F.floor(F.lit(approx) / n))).join(sizes, "segment_id", "left").na.fill(0, ["bytes"])
    ends = log.select("segment_id", (F.col("offset") + F.col("len")).alias("end"))
    near = F.broadcast(target).join(ends, "segment_id").where("end >= target").groupBy("cut_id", "segment_id").agg(F.min("end").alias("end"))
    moved = target.join(near, ["cut_id", "segment_id"], "left").withColumn("to", F.coalesce("end", F.greatest("bytes", "offset")))
    moved = moved.withColumn("stuck", ~F.bool_or(F.col("to") > F.col("offset")).over(Window.partitionBy("cut_id"))).drop("end")
    done = moved.where("stuck").select("cut_id", "segment_id").join(links, "segment_id")
    held = links.select(F.col("segment_id").alias("p"), "successor").join(moved.select("cut_id", F.col("segment_id").alias("p"), (F.col("offset") < F.col("bytes")).alias("unread")), "p").where("unread")
    free = done.join(held.select("cut_id", "successor"), ["cut_id", "successor"], "left_anti")
    gone = free.select("cut_id", "segment_id").distinct()
    stay = moved.join(gone, ["cut_id", "segment_id"], "left_anti").select("cut_id", "segment_id", F.col("to").cast("long").alias("offset"))
    return stay.unionByName(free.select("cut_id", F.col("successor").alias("segment_id"), F.lit(0).cast("long").alias("offset")).distinct())


def encode(cuts: DataFrame, stream: str) -> DataFrame:
    """cut_id, text: base64 of ``stream:id-offset,...`` in the order of ids."""
    listed = cuts.groupBy("cut_id").agg(F.sort_array(F.collect_list(F.struct("segment_id", "offset"))).alias("items"))
    parts = F.transform("items", lambda i: F.concat_ws(":", i["segment_id"].cast("string"), i["offset"].cast("string")))
    return listed.select("cut_id", F.base64(F.concat(F.lit(stream + ";"), F.array_join(parts, ",")).cast("binary")).alias("text"))


def decode(texts: DataFrame) -> DataFrame:
    """The inverse: cut_id, stream, segment_id, offset."""
    raw = texts.select("cut_id", F.split(F.unbase64("text").cast("string"), ";").alias("p"))
    item = raw.select("cut_id", F.col("p")[0].alias("stream"), F.explode(F.split(F.col("p")[1], ",")).alias("i"))
    return item.select("cut_id", "stream", F.split("i", ":")[0].cast("long").alias("segment_id"), F.split("i", ":")[1].cast("long").alias("offset"))


def daily(log: DataFrame, epochs: DataFrame, first_day: str, days: int, starts=(0, 10, 20)) -> DataFrame:
    """A cut at the end of each day: the tail of every segment then active."""
    spark = log.sparkSession
    at = F.datediff(F.col("ts").cast("date"), F.lit(first_day).cast("date"))
    tails = log.groupBy("segment_id", at.alias("day")).agg(F.max(F.col("offset") + F.col("len")).alias("end"))
    epoch = F.lit(0)
    for e, d in list(enumerate(starts))[1:]:
        epoch = F.when(F.col("cut_id") >= d, e).otherwise(epoch)
    live = spark.range(days).select(F.col("id").alias("cut_id")).withColumn("epoch", epoch).join(epochs.select("epoch", "segment_id"), "epoch")
    t = tails.select(F.col("segment_id").alias("s"), "day", "end")
    return live.join(t, (F.col("segment_id") == F.col("s")) & (F.col("day") <= F.col("cut_id")), "left").groupBy("cut_id", "segment_id").agg(F.coalesce(F.max("end"), F.lit(0)).cast("long").alias("offset"))
