"""Attribute updates: what each update kind leaves, as aggregates; compare-and-set as a fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.fold import fold


def accumulate(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("value"))


def replace(df: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """The last value."""
    return df.groupBy(*keys).agg(F.max_by(value, seq).alias("value"))


def referenced(df: DataFrame, keys: list[str], reference: str, seq: str, adjustment: int = 0) -> DataFrame:
    """The last value of an attribute that refers to another property, such as the segment's length: the property as it was when
    the update was applied, plus ``adjustment``."""
    return df.groupBy(*keys).agg((F.max_by(reference, seq) + adjustment).alias("value"))


def set_once(df: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """The first value; every later update fails."""
    return df.groupBy(*keys).agg(F.min_by(value, seq).alias("value"), (F.count("*") - 1).alias("rejected"))


def replace_if_greater(df: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """The greatest value, and how many updates failed for not exceeding all before."""
    before = F.max(value).over(Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    bad = df.withColumn("__bad", F.coalesce(F.col(value) <= before, F.lit(False)))
    return bad.groupBy(*keys).agg(F.max(value).alias("value"), F.sum(F.col("__bad").cast("long")).alias("rejected"))


def compare_and_set(df: DataFrame, keys: list[str], value: str, expected: str, seq: str, schema: str) -> DataFrame:
    """Each update with ok and the value after it: it holds only if the present value is the expected one.

    A missing value fails against every expectation but none at all (null sets unconditionally)."""

    def step(state, row):
        ok = row[expected] is None or (state is not None and state == row[expected])
        state = row[value] if ok else state
        return state, {**{k: row[k] for k in keys}, seq: row[seq], "ok": ok, "current": state}

    return fold(df.select(*keys, seq, value, expected), keys, [seq], lambda: None, step, schema)


def conditional_appends(df: DataFrame, keys: list[str], seq: str, length: str, expected: str) -> DataFrame:
    """Appends that name the length they expect: each with accepted and the segment's length after it."""

    def step(size, row):
        ok = row[expected] is None or row[expected] == size
        size += row[length] if ok else 0
        return size, {**{k: row[k] for k in keys}, seq: row[seq], "accepted": ok, "size": size}

    schema = ", ".join([*(f"{k} {dict(df.dtypes)[k]}" for k in keys), f"{seq} {dict(df.dtypes)[seq]}", "accepted boolean", "size long"])
    return fold(df.select(*keys, seq, length, expected), keys, [seq], lambda: 0, step, schema)


def first_by_number(df: DataFrame, writer: str, number: str, arrival: str) -> DataFrame:
    """Appends that survive resends: those whose number exceeds all the writer sent before."""
    before = F.max(number).over(Window.partitionBy(writer).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__m", before).where(F.col("__m").isNull() | (F.col(number) > F.col("__m"))).drop("__m")
