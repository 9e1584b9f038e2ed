"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a long, b long) -> key, label (the least key reachable), for keys that have an edge.

    Every step is two shuffles of the edges left; edges are written to the shared folder after each
    round, so no lineage builds up.  Rounds grow with the logarithm of the longest chain."""
    star = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_ = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    before = print_(star)
    while True:
        # large star: a node's greater neighbours go to the least of its neighbourhood
        both = star.select("a", "b").unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        low = large.where("a > b")
        small_least = low.groupBy("a").agg(F.min("b").alias("m"))
        joined = low.join(small_least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        after = scratch.save(small.where("a <> b").distinct())
        now = print_(after)
        scratch.drop(star)
        star = after
        if now == before:
            break
        before = now
    roots = star.select(F.col("b").alias("key"), F.col("b").alias("label")).distinct()
    return star.select(F.col("a").alias("key"), F.col("b").alias("label")).unionByName(roots)
