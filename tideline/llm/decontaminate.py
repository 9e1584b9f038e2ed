"""Benchmark decontamination with DataFrame functions only.

Benchmark items are cut into windows of ``window`` words (a shorter item is one window).  Each window
is known by its anchor, the hash of its first words; the anchors with their windows form a
broadcast hash set, as long as the benchmark is under ``BROADCAST_BYTES`` - beyond that hashes of whole
windows are joined by a shuffle.  A document's word positions probe the set by anchor, the whole window is then compared word for
word (the verification), and only hits are shuffled, by hashes of the text.

Defined cases: a null or empty text or item has no words, so no windows and no hits; repeated items
count by distinct id; items without an id hit like others, count as one item, and aren't in the hash of the ids; repeated document rows each have a result; other columns are carried along
whatever their names; texts of any length are read whole; an empty table on either side gives no hits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Scratch

WINDOW = 13
ANCHOR = 3
BROADCAST_BYTES = 64 << 20
#: ASCII that isn't a letter or digit, after lower-casing; and in a text as written.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), lambda w: w != "")


def _anchor(w: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(w, i + j) for j in range(n)))


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id") -> DataFrame:
    """Distinct windows: anchor, anchor_words, win (array of words), items (sorted ids as strings, null last)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    cut = items.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))), lambda i: F.slice("w", i + 1, window))).alias("win"))
    each = cut.groupBy("win").agg(F.array_sort(F.transform(F.collect_set(F.struct("item")), lambda x: x["item"])).alias("items"))
    n = F.least(F.size("win"), F.lit(ANCHOR))
    return each.withColumn("anchor_words", n).withColumn(
        "anchor", F.when(n == 3, _anchor(F.col("win"), F.lit(0), 3)).when(n == 2, _anchor(F.col("win"), F.lit(0), 2)).otherwise(_anchor(F.col("win"), F.lit(0), 1))
    )


NAMES = ("n_words", "hit_words", "hit_items")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``docs`` with three columns ``names``: the number of words, sorted positions of hit words, and sorted ids of hit items (null last).

    Names that docs already has are replaced.  Rows are known by two hashes of their text, so rows of one text share their hits."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    wins = item_windows(benchmark, window, id_col)
    stats = wins.agg(F.collect_set("anchor_words"), F.sum(F.octet_length(F.concat_ws(" ", "win")) + F.octet_length(F.concat_ws(" ", "items")) + 64), F.collect_set(F.size("win"))).first()
    keys = F.xxhash64("text"), F.xxhash64(F.lit(7), "text")
    w = docs.select(keys[0].alias("k1"), keys[1].alias("k2"), words(F.col("text")).alias("w"))
    find = _found_by_anchor if (stats[1] or 0) <= BROADCAST_BYTES else _found_by_shuffle
    spans = find(w, wins, sorted((stats[0] if find is _found_by_anchor else stats[2]) or []))
    each = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.collect_set("items").alias("sets"))
    each = each.select(
        "k1", "k2",
        F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten("sets"))).alias("hit_items"),
    )
    each = scratch.save(each)
    size = each.agg(F.sum(F.size("hit_words") * 4 + F.octet_length(F.concat_ws(" ", "hit_items")) + 64)).first()[0] or 0
    tag = uuid.uuid4().hex[:8]
    found = each.toDF(*(f"__{n}_{tag}" for n in each.columns))
    k1, k2, at, items = (F.col(c) for c in found.columns)
    own = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    full = docs.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, (k1 == keys[0]) & (k2 == keys[1]), "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return full.select(*own, F.size(words(F.col("text"))).cast("long").alias(names[0]), empty(at, "int").alias(names[1]), empty(items, "string").alias(names[2]))


def _found_by_anchor(w: DataFrame, wins: DataFrame, lengths: list[int]) -> DataFrame:
    """(k1, k2, at, n, items): the windows are broadcast, so words are compared where they are."""
    table = wins.select(F.col("anchor").alias("a"), "win", "items")
    # _outer: of an inner explode Catalyst infers a filter that would split the text anew for each word
    probes = w.withColumn("h", _anchors(F.col("w"), lengths)).select("k1", "k2", "w", F.posexplode_outer("h").alias("pos", "a"))
    at = F.col("pos") if len(lengths) < 2 else F.floor(F.col("pos") / F.lit(len(lengths))).cast("int")
    found = probes.join(F.broadcast(table), "a").withColumn("at", at).where(F.slice("w", F.col("at") + 1, F.size("win")) == F.col("win"))
    return found.select("k1", "k2", "at", F.size("win").alias("n"), "items")


def _found_by_shuffle(w: DataFrame, wins: DataFrame, sizes: list[int]) -> DataFrame:
    """The same beyond what may be broadcast: hashes of whole windows are joined, and only texts with candidates come back for the comparison."""
    whole = lambda x: F.xxhash64(F.concat_ws(" ", x))
    table = wins.select(F.size("win").alias("n"), whole(F.col("win")).alias("h"), "win", "items")
    cut = lambda i: F.array(*(F.when(i + n <= F.size("w"), F.struct(i.alias("at"), F.lit(n).alias("n"), whole(F.slice("w", i + 1, n)).alias("h"))) for n in sizes))
    each = F.flatten(F.transform(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)), cut)) if sizes else F.array().cast("array<struct<at:int,n:int,h:bigint>>")
    probes = w.select("k1", "k2", F.explode_outer(each).alias("x")).where("x is not null").select("k1", "k2", "x.*").distinct()
    near = probes.join(table, ["n", "h"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "n", "win", "items")).alias("xs"))
    true = F.filter("xs", lambda x: F.slice("w", x["at"] + 1, x["n"]) == x["win"])
    return w.join(near, ["k1", "k2"]).select("k1", "k2", F.explode(true).alias("x")).select("k1", "k2", "x.at", "x.n", "x.items")


def _anchors(w: Column, lengths: list[int]) -> Column:
    """Position by position the hash of each anchor length in use (null past the end)."""
    if not lengths:
        return F.array().cast("array<bigint>")
    if len(lengths) == 1:
        return F.transform(F.when(F.size(w) >= lengths[0], F.sequence(F.lit(0), F.size(w) - lengths[0])), lambda i: _anchor(w, i, lengths[0]))
    each = lambda i: F.array(*(F.when(i + n <= F.size(w), _anchor(w, i, n)) for n in lengths))
    return F.flatten(F.transform(F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)), each))


def report(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n = F.size("hit_words").cast("long")
    return hits(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", n.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        ((n > 0) & (share * n >= F.col("n_words"))).alias("contaminated"),
    )


def _own_names() -> tuple[str, str, str]:
    return tuple(f"__{n}_{uuid.uuid4().hex[:8]}" for n in NAMES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: int = 20, cut: bool = False) -> DataFrame:
    """Documents of which 1 in ``share`` words or more is hit go; with ``cut``, those that stay lose their hit words.  The columns stay."""
    own, (total, at, items) = docs.columns, _own_names()
    marked = hits(docs, benchmark, names=(total, at, items))
    n = F.size(at).cast("long")
    kept = marked.where(~((n > 0) & (share * n >= F.col(total))))
    return _without(kept, at, own) if cut else kept.select(*(F.col(f"`{c}`") for c in own))


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with each hit word taken out of ``text``, with what stands between it and the next word; all else stays as written."""
    names = _own_names()
    return _without(hits(docs, benchmark, names=names), names[1], docs.columns)


def _without(marked: DataFrame, at: str, own: list[str]) -> DataFrame:
    text = F.col("text")
    pieces = F.regexp_extract_all(text, F.lit(f"[^{BETWEEN}]+[{BETWEEN}]*"), F.lit(0))
    # a lambda is worked out anew for each element, so it holds nothing but columns
    stay = F.filter(pieces, lambda x, i: ~F.array_contains(F.col(at), i))
    kept = F.concat(F.regexp_extract(text, f"^[{BETWEEN}]*", 0), F.array_join(stay, ""))
    return marked.select(*(F.when(F.size(at) == 0, text).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in own))
