"""Event-time watermarks from many writers' marks."""

from __future__ import annotations

from itertools import dropwhile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.fold import fold


def accepted_marks(marks: DataFrame) -> DataFrame:
    """marks (writer_id, seq, ts_ms, position: map of segment to offset) with result.

    INVALID_TIME if the time is before the stored mark's, INVALID_POSITION if an offset falls in a segment that both positions have, else SUCCESS,
    and the mark is stored.  A rejected mark leaves the stored one as it is, so the outcome depends on all before: a fold by writer.
    A null time counts as before any other, a null position has no segments."""

    def step(stored, row):
        ts, position = row["ts_ms"], dict(row["position"] or [])
        if stored is not None and (ts is None or stored[0] is not None and ts < stored[0]):
            result = "INVALID_TIME"
        elif stored is not None and any(position[s] < o for s, o in stored[1].items() if s in position):
            result = "INVALID_POSITION"
        else:
            result, stored = "SUCCESS", (ts, position)
        return stored, {**row, "result": result}

    schema = ", ".join(f"{c} {k}" for c, k in (*marks.dtypes, ("result", "string")))
    return fold(marks, ["writer_id"], ["seq"], lambda: None, step, schema)


def appended_marks(attempts: DataFrame) -> DataFrame:
    """attempts (stream, seq, expected) of several controllers to append a watermark -> each with written, revision and mark.

    An append holds only if ``expected`` is the revision of the last watermark (null: it has just been read), so of controllers that
    saw the same one, one wins.  Revisions count from 1, and 0 is the empty stream; the mark pointer trails by one watermark."""

    def step(state, row):
        tail, mark = state
        if ok := row["expected"] is None or row["expected"] == tail:
            tail, mark = tail + 1, tail
        return (tail, mark), {"stream": row["stream"], "seq": row["seq"], "written": ok, "revision": tail, "mark": mark}

    return fold(attempts.select("stream", "seq", "expected"), ["stream"], ["seq"], lambda: (0, 0), step, "stream string, seq long, written boolean, revision long, mark long")


def bounds(marks: DataFrame, by: str) -> DataFrame:
    """lower and upper time bound of each round: least and greatest time of its writers."""
    return marks.groupBy(by).agg(F.min("ts_ms").alias("lower"), F.max("ts_ms").alias("upper"), F.count("*").alias("writers"))


def strictly_rising(rounds: DataFrame, by: str) -> DataFrame:
    """Only rounds whose lower bound exceeds that of all before.  Rounds are metadata: a row per emission period."""
    before = F.max("lower").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    return rounds.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("lower") > F.col("__b"))).drop("__b")


def gate(marks: DataFrame, previous: DataFrame, now: int, timeout: int) -> DataFrame:
    """marks (stream, writer_id, ts_ms, alive, reported_at), previous (stream, lower) -> stream, active, participating, decision.

    A writer participates if its time is past the last watermark; it is active if it participates, or is
    alive and not silent for ``timeout``.  No active writer: stop; one that doesn't participate: wait; else emit."""
    j = marks.join(previous, "stream", "left")
    taking = F.col("lower").isNull() | (F.col("ts_ms") > F.col("lower"))
    active = taking | (F.col("alive") & (F.lit(now) - F.col("reported_at") < timeout))
    each = j.select("stream", taking.cast("long").alias("p"), active.cast("long").alias("a"))
    out = each.groupBy("stream").agg(F.sum("a").alias("active"), F.sum("p").alias("participating"))
    return out.withColumn("decision", F.when(F.col("active") == 0, "stop").when(F.col("participating") < F.col("active"), "wait").otherwise("emit"))


def fill(cut: dict[int, int], epochs: list[tuple[int, int, float, float]]) -> dict[int, int]:
    """A cut made whole: gaps in the key space get segments of the highest epoch there is in the cut, at 0.

    Segments that a filled-in one makes obsolete drop out; loops until the cut covers all, at most once per epoch."""
    ranges = {s: (a, b) for _, s, a, b in epochs}
    cut = _latest(dict(cut), ranges)
    for top in range(max([s >> 32 for s in cut], default=0), max(e for e, *_ in epochs) + 1):
        gaps, at = [], 0.0
        for a, b in sorted(ranges[s] for s in cut):
            if a > at:
                gaps.append((at, a))
            at = max(at, b)
        if at < 1.0:
            gaps.append((at, 1.0))
        if not gaps:
            break
        for e, s, a, b in epochs:
            if e == top and any(a < y and b > x for x, y in gaps):
                cut.setdefault(s, 0)
        cut = _latest(cut, ranges)
    return cut


def _latest(cut: dict[int, int], ranges: dict[int, tuple[float, float]]) -> dict[int, int]:
    passed = lambda s: any(o > s and ranges[o][0] < ranges[s][1] and ranges[o][1] > ranges[s][0] for o in cut)
    return {s: o for s, o in cut.items() if not passed(s)}


def emit(marks: list[dict], previous: dict | None, epochs: list[tuple[int, int, float, float]]) -> dict | None:
    """The watermark of one round: marks with ts_ms and position {segment: offset}; None if time doesn't move on.

    Marks and epochs are metadata of one stream: a row per writer, and per segment and epoch."""
    lower = min(m["ts_ms"] for m in marks)
    if previous and lower <= previous["lower"]:
        return None
    cut: dict[int, int] = dict(previous["cut"]) if previous else {}
    for m in marks:
        for s, o in m["position"].items():
            cut[s] = max(cut.get(s, 0), o)
    return {"lower": lower, "upper": max(m["ts_ms"] for m in marks), "cut": fill(cut, epochs)}


def compare_position(position: dict[int, int], mark: dict[int, int], ranges: dict[int, tuple[float, float]]) -> int:
    """1: at or past the mark everywhere; -1: before it everywhere or in part; 0: on both sides."""
    more = less = same = False
    for s, o in position.items():
        for t, p in mark.items():
            if ranges[s][0] < ranges[t][1] and ranges[s][1] > ranges[t][0]:
                if s == t:
                    beyond = (o < 0) - (p < 0) if (o < 0) != (p < 0) else (o > p) - (o < p)
                else:
                    beyond = (s > t) - (s < t)
                more, less, same = more or beyond > 0, less or beyond < 0, same or beyond == 0
    if not less:
        return 1
    return 0 if more else -1


class TimeWindow:
    """A reader's (lower, upper) time: the lower bound of the last mark passed, the upper of the last ahead of it.

    ``ahead`` holds the marks looked at but not passed; it reaches to the first one that lies wholly after the position."""

    def __init__(self, marks: list[dict], ranges: dict[int, tuple[float, float]]):
        self.marks, self.ranges, self.ahead, self.lower = iter(marks), ranges, [], None

    def advance(self, position: dict[int, int]) -> tuple[int | None, int | None]:
        side = lambda m: compare_position(position, m["cut"], self.ranges)
        left = list(dropwhile(lambda m: side(m) > 0, self.ahead))
        if passed := self.ahead[: len(self.ahead) - len(left)]:
            self.lower = passed[-1]["lower"]
        self.ahead = left
        while not self.ahead or side(self.ahead[-1]) >= 0:
            if (m := next(self.marks, None)) is None:
                break
            if side(m) > 0:
                self.lower = m["lower"]
            else:
                self.ahead.append(m)
        return self.lower, self.ahead[-1]["upper"] if self.ahead else None
