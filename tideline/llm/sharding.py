"""K-d tree sharding with DataFrame functions only; the law is ``bytes``: shard sizes are near equal.

What the tree divides are items: all rows of one text, placed by the least metadata among them, so equal
texts share a shard.  A text whose rows weigh over 1/64 of a shard, but fit in one, is seated whole before the
tree is built, heaviest first in the emptiest shard; the tree then aims at what room each shard has left.  Only a text
that no shard can hold is dealt into pieces by hash of the id.  There are at most 64 seated texts a shard, and
fewer dealt ones than shards, which bounds what is collected and broadcast.  A node is cut along the dimension in which its
items spread widest, at the weighted median, found by histograms: each pass counts bytes in ``BINS`` bins per node and
narrows to the bin that holds the median.  Only bins reach the driver, never rows.

Defined cases: a null text weighs 1 byte and its CRC is 0; null metadata counts as 0; repeated rows are rows
of their own, with slots of their own; an empty table gives no rows; columns beyond ``dimensions`` aren't read.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import Scratch

BINS = 1024
BITS = 52
PIECES_A_SHARD = 64
EXACT_SHARE = 0.0005
SLOT_ROWS = 50_000


@dataclass
class Split:
    node: int
    dimension: str
    cut: int  # items with a position below it go left
    left: int
    right: int


def _dimension(column: str, kind: str) -> Column:
    c = F.col(f"`{column}`")
    value = F.crc32(c).cast("double") if kind == "string" else F.log1p(F.abs(c.cast("double")))
    return F.coalesce(value, F.lit(0.0))


def _position(d: str, low: float, high: float) -> Column:
    """A whole number under 2**52: the place along the dimension, equal places in hash order."""
    scale = (1 << 20) - 1
    share = (F.col(d) - F.lit(low)) / F.lit((high - low) or 1.0)
    return F.shiftleft(F.floor(share * scale).cast("long"), 32) + F.pmod(F.xxhash64("g", "piece", F.lit(d)), F.lit(1 << 32))


def _at(values: list, node: Column) -> Column:
    """values[node], as one constant array whatever the number of nodes."""
    return F.get(F.split(F.lit(",".join(str(v) for v in values)), ",").cast("array<long>"), node)


def _node(splits: list[Split], dimensions: list[str]) -> Column:
    """The leaf an item is in so far: one step down for each level, by look-ups in arrays."""
    size = 1 + max((s.right for s in splits), default=0)
    along, cut, left = [0] * size, [0] * size, [-1] * size
    depth = [0] * size
    for s in splits:  # a node's own split comes after its parent's
        along[s.node], cut[s.node], left[s.node] = dimensions.index(s.dimension), s.cut, s.left
        depth[s.left] = depth[s.right] = depth[s.node] + 1
    places = F.array(*(F.col(f"p_{d}") for d in dimensions))

    def down(node: Column, _: Column) -> Column:
        right = (F.get(places, _at(along, node).cast("int")) >= _at(cut, node)).cast("int")
        return F.when(_at(left, node) < 0, node).otherwise((_at(left, node) + right).cast("int"))

    if not splits:
        return F.lit(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(depth))), F.lit(0), down)


@dataclass
class Search:
    """The median of a node: its place lies in [low, high), with ``before`` bytes in front of that."""

    dimension: str
    target: float
    total: float
    low: int = 0
    high: int = 1 << BITS
    before: float = 0.0

    def narrow(self, bins: list[tuple[int, int, int]], width: int) -> int | None:
        """bins (number, bytes, items) of ``width`` places each; the cut, once it is near enough."""
        at = self.before
        for b, w, items in sorted(bins):
            if at + w >= self.target:
                start = self.low + b * width
                if width == 1 or items == 1 or w <= EXACT_SHARE * self.total:
                    return start + width if at + w - self.target < self.target - at else start
                self.low, self.high, self.before = start, start + width, at
                return None
            at += w
        return self.high


def _spread(placed: DataFrame, dimensions: list[str]) -> dict[int, dict[str, list[tuple[int, int, int]]]]:
    """node -> dimension -> (bin, bytes, items), in one pass over the items."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.shiftright(f"p_{d}", BITS - 10).cast("int").alias("bin")) for d in dimensions)))
    rows = placed.select("node", "w", each.alias("x")).groupBy("node", "x.d", "x.bin").agg(F.sum("w").alias("w"), F.count("*").alias("items")).collect()
    out: dict[int, dict[str, list[tuple[int, int, int]]]] = {}
    for r in rows:
        out.setdefault(r["node"], {}).setdefault(r["d"], []).append((r["bin"], r["w"], r["items"]))
    return out


def _refine(placed: DataFrame, open_: dict[int, Search], dimensions: list[str]) -> dict[int, int]:
    """Cuts of the nodes whose first bin was too coarse."""
    done: dict[int, int] = {}
    while open_:
        widths = {n: max(1, -(-(s.high - s.low) // BINS)) for n, s in open_.items()}
        all_ = range(max(open_) + 1)
        look = lambda f, default: _at([f(n) if n in open_ else default for n in all_], F.col("node"))
        p = F.get(F.array(*(F.col(f"p_{d}") for d in dimensions)), look(lambda n: dimensions.index(open_[n].dimension), 0).cast("int"))
        inside = (p >= look(lambda n: open_[n].low, 0)) & (p < look(lambda n: open_[n].high, 0))
        step = F.when(inside, F.floor((p - look(lambda n: open_[n].low, 0)) / look(lambda n: widths[n], 1)))
        rows = placed.withColumn("bin", step.cast("int")).where("bin is not null").groupBy("node", "bin").agg(F.sum("w").alias("w"), F.count("*").alias("items")).collect()
        bins: dict[int, list[tuple[int, int, int]]] = {}
        for r in rows:
            bins.setdefault(r["node"], []).append((r["bin"], r["w"], r["items"]))
        for n in list(open_):
            cut = open_[n].narrow(bins.get(n, []), widths[n])
            if cut is not None:
                done[n] = cut
                del open_[n]
    return done


def build(items: DataFrame, dimensions: list[str], room: list[float]) -> tuple[list[Split], dict[int, int]]:
    """items (g, piece, w, p_<dimension>...) and the bytes each shard has room for -> splits, and shard of each leaf.

    A level of the tree takes one pass for all nodes and dimensions, and one or two more where bins are too coarse."""
    splits, leaves, free = [], {0: (0, len(room))}, 1  # node -> first shard, shard behind the last
    while wide := {n: (lo, hi) for n, (lo, hi) in leaves.items() if hi - lo > 1}:
        placed = items.withColumn("node", _node(splits, dimensions)).where(_at([int(n in wide) for n in range(free)], F.col("node")) == 1)
        searches, cuts = {}, {}
        for n, by in _spread(placed, dimensions).items():
            widest = max(dimensions, key=lambda d: max(b for b, *_ in by[d]) - min(b for b, *_ in by[d]))
            total = float(sum(w for _, w, _ in by[widest]))
            lo, hi = wide[n]
            middle, all_ = (lo + hi) // 2, sum(room[lo:hi])
            share = sum(room[lo:middle]) / all_ if all_ else (middle - lo) / (hi - lo)
            searches[n] = Search(widest, total * share, total)
            cut = searches[n].narrow(by[widest], 1 << (BITS - 10))
            if cut is not None:
                cuts[n] = cut
        cuts |= _refine(placed, {n: s for n, s in searches.items() if n not in cuts}, dimensions)
        after = {n: ends for n, ends in leaves.items() if n not in wide}
        for n, (lo, hi) in wide.items():
            splits.append(Split(n, searches[n].dimension if n in searches else dimensions[0], cuts.get(n, 0), free, free + 1))
            after[free], after[free + 1] = (lo, (lo + hi) // 2), ((lo + hi) // 2, hi)
            free += 2
        leaves = after
    return splits, {n: lo for n, (lo, _) in leaves.items()}


def seat(weights: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """(text, weight) -> shard of each, heaviest first into the emptiest; and what each shard then holds."""
    heap, seats, held = [(0, s) for s in range(shards)], {}, [0] * shards
    for g, w in sorted(weights, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        seats[g], held[s] = s, load + w
        heapq.heappush(heap, (load + w, s))
    return seats, held


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = ("n_chars", "source", "lang")) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    scratch = Scratch(docs.sparkSession, "sharding")
    kinds = dict(docs.dtypes)
    dims = [d for d in dimensions if d in kinds]
    rows = docs.select(
        F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text", F.octet_length("text")).alias("g"), *(_dimension(d, kinds[d]).alias(d) for d in dims),
    ).withColumn("bytes", F.log1p(F.col("size").cast("double")))
    rows = scratch.save(rows)
    dims = [*dims, "bytes"]
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, -(-total // (target_bytes or total or 1)))
    most, whole = max(1, total // (shards * PIECES_A_SHARD)), max(1, total // shards)
    heavy = rows.groupBy("g").agg(F.sum("size").alias("all")).where(F.col("all") > most)
    seats, held = seat([(r["g"], r["all"]) for r in heavy.where(F.col("all") <= whole).collect()], shards)
    listed = F.lit(json.dumps([{"g": g, "seat": s} for g, s in seats.items()]))
    seated = docs.sparkSession.range(1).select(F.inline(F.from_json(listed, "array<struct<g: bigint, seat: int>>")))
    dealt_out = heavy.where(F.col("all") > whole).select("g", F.ceil(F.col("all") / most).cast("int").alias("pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces")), F.lit(0)).cast("int")
    rows = rows.join(F.broadcast(dealt_out), "g", "left").withColumn("piece", piece).drop("pieces").join(F.broadcast(seated), "g", "left")
    items = rows.where("seat is null").groupBy("g", "piece").agg(F.sum("size").alias("w"), *(F.min(d).alias(d) for d in dims))
    items = scratch.save(items)
    ends = items.agg(*(f(d).alias(f"{a}_{d}") for d in dims for a, f in (("lo", F.min), ("hi", F.max)))).first()
    placed = items.select("g", "piece", "w", *(_position(d, ends[f"lo_{d}"] or 0.0, ends[f"hi_{d}"] or 0.0).alias(f"p_{d}") for d in dims))
    splits, shard_of = build(placed, dims, [max(0.0, total / shards - h) for h in held])
    to_shard = _at([shard_of.get(n, 0) for n in range(max(shard_of) + 1)], F.col("node")).cast("int")
    placed = placed.withColumn("node", _node(splits, dims)).select("g", "piece", to_shard.alias("shard"))
    free = rows.where("seat is null").select("doc_id", "size", "text_crc32", "g", "piece").join(placed, ["g", "piece"]).drop("g", "piece")
    fixed = rows.where("seat is not null").select("doc_id", "size", "text_crc32", F.col("seat").alias("shard"))
    return slots(scratch.save(free.unionByName(fixed)))


def slots(dealt: DataFrame) -> DataFrame:
    """Adds law, slot and grown_shard to a written table: slots count up from 0 in each shard without a gap.

    Rows are numbered in buckets of about ``SLOT_ROWS``; the buckets' row counts before give the rest."""
    n = dealt.count()
    buckets = max(1, min(4096, n // (16 * SLOT_ROWS) + 1))
    rows = dealt.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")) - 1
    numbered = rows.withColumn("own", own).join(F.broadcast(starts), ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
