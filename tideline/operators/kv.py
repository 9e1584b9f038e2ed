"""Key-value tables as change logs: rows (pk, sk, value, version, is_delete)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.fold import fold

KEY = ["pk", "sk"]


def latest(log: DataFrame) -> DataFrame:
    """The live entries.  One aggregation with a partial step before the shuffle, so hot keys are combined early."""
    last = log.groupBy(*KEY).agg(F.max_by(F.struct("value", "version", "is_delete"), "version").alias("e"))
    return last.where("not e.is_delete").select(*KEY, "e.value", "e.version")


def in_range(table: DataFrame, pk: Column | str | None = None, low=None, high=None, column: str = "sk") -> DataFrame:
    """Inclusive bounds, unsigned byte order."""
    out = table if pk is None else table.where(F.col("pk") == pk)
    c = F.col(column).cast("binary")
    if low is not None:
        out = out.where(c >= F.lit(low).cast("binary"))
    return out if high is None else out.where(c <= F.lit(high).cast("binary"))


def with_prefix(table: DataFrame, prefix: str, column: str = "sk") -> DataFrame:
    return table.where(F.col(column).startswith(prefix))


def multi_get(table: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (place, pk, sk) -> place, value, version; nulls where the key is missing."""
    return keys.join(table, KEY, "left").select("place", *KEY, "value", "version")


def page(table: DataFrame, after: tuple | None, n: int) -> DataFrame:
    """The next ``n`` entries by key after a token (pk, sk)."""
    out = table
    if after is not None:
        out = out.where(F.struct(*KEY) > F.struct(*(F.lit(x) for x in after)))
    return out.orderBy(*KEY).limit(n)


def delta(log: DataFrame, since: int, head: int = 0) -> DataFrame:
    """Changes from a version on, one per key: its last; ``should_clear`` says that some were truncated before."""
    last = log.where(F.col("version") >= since).groupBy(*KEY).agg(F.max_by(F.struct("value", "version", "is_delete"), "version").alias("e"))
    return last.select(*KEY, F.when(~F.col("e.is_delete"), F.col("e.value")).alias("value"), "e.version", "e.is_delete", F.lit(since < head).alias("should_clear"))


def utilisation(log: DataFrame, by: list[str]) -> DataFrame:
    """total and unique entries, and the share of unique ones in percent (compaction looks at it)."""
    per_key = log.groupBy(*by, *KEY).agg(F.count("*").alias("n"))
    out = per_key.groupBy(*by).agg(F.sum("n").alias("total"), F.count("*").alias("unique"))
    return out.withColumn("percent", F.round(100 * F.col("unique") / F.col("total")).cast("int"))


def compact(log: DataFrame, threshold: int = 75) -> DataFrame:
    """The log rewritten to its live entries (pk by pk where utilisation is under the threshold)."""
    low = utilisation(log, ["pk"]).where(F.col("percent") < threshold).select("pk")
    small = latest(log.join(low, "pk", "left_semi")).withColumn("is_delete", F.lit(False))
    return log.join(low, "pk", "left_anti").select(*KEY, "value", "version", "is_delete").unionByName(small)


def conditional(updates: DataFrame, schema: str) -> DataFrame:
    """updates (pk, batch, sk, kind, value, expected): batches apply whole or not at all, in order, within a pk.

    kind: insert, put or remove; expected: a version or null.  -> each update with its result: Ok, NoSuchKey,
    BadKeyVersion, MixedBatch (removes and updates together), or Aborted (another of the batch failed)."""
    each = updates.groupBy("pk", "batch").agg(F.sort_array(F.collect_list(F.struct("sk", "kind", "value", "expected"))).alias("items"))

    def step(state, row):
        table, version = state
        kinds = {i["kind"] for i in row["items"]}
        results = []
        for i in row["items"]:
            now = table.get(i["sk"])
            if "remove" in kinds and len(kinds) > 1:
                results.append("MixedBatch")
            elif i["kind"] == "insert":
                results.append("Ok" if now is None else "BadKeyVersion")
            elif i["expected"] is None:
                results.append("Ok")
            elif now is None:
                results.append("NoSuchKey")
            else:
                results.append("Ok" if now == i["expected"] else "BadKeyVersion")
        if all(r == "Ok" for r in results):
            table = dict(table)
            for i in row["items"]:
                version += 1
                if i["kind"] == "remove":
                    table.pop(i["sk"], None)
                else:
                    table[i["sk"]] = version
        else:
            results = ["Aborted" if r == "Ok" else r for r in results]
        return (table, version), {"pk": row["pk"], "batch": row["batch"], "results": results, "live": len(table), "version": version}

    return fold(each, ["pk"], ["batch"], lambda: ({}, 0), step, schema)
