"""Event rates and scale decisions."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TICK = 5
MINUTES = (2, 5, 10, 20)
#: Smoothing by window: 1 - exp(-tick / window).
ALPHAS = {m: 1 - exp(-TICK / 60 / m) for m in MINUTES}
COOLDOWN, MUTE = 600, 600


def ewma(ticks: DataFrame, keys: list[str], at: int) -> DataFrame:
    """keys, rate_<minutes> at tick ``at`` from (tick, n events): exponentially weighted means of n / TICK.

    The first tick seeds the mean and silent ticks decay it, so the mean is a sum of weighted ticks, which needs no
    order: one aggregation, combined before the shuffle."""
    first = ticks.groupBy(*keys).agg(F.min("tick").alias("first"))
    out = []
    for m in MINUTES:
        keep = F.pow(F.lit(1 - ALPHAS[m]), F.lit(at) - F.col("tick"))
        out.append(F.sum(F.col("n") / TICK * keep * F.when(F.col("tick") == F.col("first"), 1.0).otherwise(ALPHAS[m])).alias(f"rate_{m}"))
    return ticks.where(F.col("tick") <= at).join(first, keys).groupBy(*keys).agg(*out)


def contribution(n: Column, size: Column, lifetime: Column, kind: str, tick: int = TICK * 1000) -> Column:
    """What a write of ``n`` events and ``size`` bytes adds to the count of its tick, by the kind of rate: bytes or events.

    A transaction open for a tick (in milliseconds) or longer counts with the share of one tick, in whole units."""
    whole = {"bytes": size, "events": n}[kind].cast("long")
    spread = whole * tick
    return F.when(lifetime < tick, whole).otherwise(((spread - spread % lifetime) / lifetime).cast("long"))


def in_unit(rate: Column, kind: Column) -> Column:
    """Kilobytes or events a second; any other kind, such as that of fixed streams, has no rate."""
    return F.when(kind == "bytes", rate / 1024).when(kind == "events", rate)


def decision(target: Column, age: Column) -> Column:
    """up, down or none from rates and the segment's age in seconds."""
    r = {m: F.col(f"rate_{m}") for m in MINUTES}
    minutes = lambda m: age > 60 * m
    up = ((r[2] > 5 * target) & minutes(2)) | ((r[5] > 2 * target) & minutes(5)) | ((r[10] > target) & minutes(10))
    down = (r[2] < target) & (r[5] < target) & (r[10] < target) & (r[20] < target / 2) & minutes(20)
    return F.when(age <= COOLDOWN, "none").when(up, "up").when(down, "down").otherwise("none")


def splits(target: Column) -> Column:
    return F.greatest(F.lit(2), (F.greatest("rate_2", "rate_5", "rate_10") / target).cast("int"))


def unmuted(requests: DataFrame, mute: int = MUTE) -> DataFrame:
    """Requests (segment_id, at, kind) that aren't suppressed: up mutes both kinds for ``mute`` seconds, down only down.

    A muted request mutes nothing, which makes it a fold."""
    from tideline.operators.fold import fold

    def step(state, row):
        up, down = state
        last = max(x for x in ((up,) if row["kind"] == "up" else (up, down)))
        if row["at"] - last <= mute:
            return state, None
        return ((row["at"], down) if row["kind"] == "up" else (up, row["at"])), dict(row)

    far = -(1 << 62)
    return fold(requests.select("segment_id", "at", "kind"), ["segment_id"], ["at", "kind"], lambda: (far, far), step, "segment_id long, at long, kind string")
