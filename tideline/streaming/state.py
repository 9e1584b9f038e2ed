"""Replayable shared state: in batch as a fold, and as a streaming query with state per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.operators.fold import fold


def synchronized(updates: DataFrame, keys: list[str]) -> DataFrame:
    """updates (keys, revision, kind init or update, value, expected) -> each with applied and the state after it.

    An update that expects a revision holds only if that is the last one applied; before an Init there is no state."""

    def step(state, row):
        value, last = state
        if row["kind"] == "init":
            value, last, ok = row["value"], row["revision"], True
        elif value is None or (row["expected"] is not None and row["expected"] != last):
            ok = False
        else:
            value, last, ok = value + row["value"], row["revision"], True
        return (value, last), {**{k: row[k] for k in keys}, "revision": row["revision"], "applied": ok, "state": value}

    kinds = dict(updates.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "revision long, applied boolean, state long"])
    return fold(updates, keys, ["revision"], lambda: (None, None), step, schema)


def generated(requests: DataFrame, keys: list[str], order: str, start: object, generate: Callable, apply: Callable, compact: Callable, every: int, kind: str) -> DataFrame:
    """requests (keys, order and what the functions read) -> each with the updates it made, the state after it, and the updates since compaction.

    ``generate(state, row)`` gives a request's updates, none if it changes nothing; ``apply(state, update)`` the next state.  Once ``every``
    updates or more were written since the last one, ``compact(state)`` becomes the new initial state.  ``kind``: SQL type of the state."""

    def step(state, row):
        value, since = state
        made = generate(value, row)
        for update in made:
            value = apply(value, update)
        since += len(made)
        if since >= every:
            value, since = compact(value), 0
        return (value, since), {**{k: row[k] for k in keys}, order: row[order], "updates": len(made), "state": value, "since": since}

    kinds = dict(requests.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in (*keys, order)), f"updates long, state {kind}, since long"])
    return fold(requests, keys, [order], lambda: (start, 0), step, schema)


def restarted(log: DataFrame, keys: list[str], head: int) -> DataFrame:
    """The state that one reads after truncation at ``head``: keys, init (revision of the last Init from there on), state and bytes_since.

    log (keys, revision, kind init or update, value, bytes).  Updates before that Init don't count, so no order is needed: a sum.  Without an
    Init there is no state: nulls."""
    kept = log.where(F.col("revision") >= head)
    last = kept.groupBy(*keys).agg(F.max(F.when(F.col("kind") == "init", F.col("revision"))).alias("init"))
    from_init = F.col("revision") >= F.col("init")
    sums = (F.sum(F.when(from_init, F.col("value"))).alias("state"), F.sum(F.when(from_init, F.col("bytes"))).alias("bytes_since"))
    return kept.join(last, keys).groupBy(*keys, "init").agg(*sums)


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """A streaming query's count per key, kept in the query's checkpointed state (update mode)."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "n": [n]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long", "n long", "update", GroupStateTimeout.NoTimeout)
