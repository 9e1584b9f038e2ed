"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 75 % or more.

Equal sets are one class.  Classes are routed to trees by prefix filtering: two sets that link share one of
the rarest shingles of each (a quarter of the set), so every shingle that is among the rarest of two
or more classes is a tree, and trees over the same classes are one tree.  In a tree a class is a point
of counts: its shingles, hashed into groups - about half as many as it has shingles - counted by group.  The summed coordinate minima of two
points bound their overlap; of a point and a node's upper corner, the overlap with anything below the
node.  Pairs that no bound excludes are verified on their whole sets.

Only connections matter, so trees are searched in rounds: first each class against one leader of its tree, then
against its likeliest partners of other components, then against all that are left of other
components.  No round drops a pair that the last one would have found.  Large trees are dealt out in pairs of
blocks in the later rounds.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with nothing; under
five words the whole sequence is one shingle; repeated rows are rows of their own; a row with a null
doc_id gets no component; other columns aren't read.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import Scratch, buckets_for, text_bytes
from tideline.llm.components import components
from tideline.llm.substring_dedup import ENTRY, _planes, _rows, _unplanes
from tideline.llm.textkernel import SPACES, Splitter, mix, string_buffer, tidied, tidy, windows

SHINGLE = 5
GROUPS, MOST_GROUPS, FULL = 64, 4096, 65535
BUCKET_BYTES = 8 << 20
CHUNK_SHINGLES = 1 << 20
MASK40 = np.uint64((1 << 40) - 1)
BLOCK = 2048
LEAF = 16
BROADCAST_BYTES = 48 << 20
LIKELIEST = 2


def needed(a, b):
    """Least overlap of sets of ``a`` and ``b`` shingles that link: 100 i >= 75 (a + b - i)."""
    return -(-3 * (a + b) // 7)


def shingle_sets(splitter: Splitter, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, _, _, first = splitter.words(data, offsets)
    sh, pos = windows(h, first, SHINGLE, seed=1)
    cut = np.searchsorted(pos, first)
    out = []
    for d in range(len(first) - 1):
        s = sh[cut[d] : cut[d + 1]]
        n = int(first[d + 1] - first[d])
        if 0 < n < SHINGLE:
            s, _ = windows(h[first[d] : first[d + 1]], np.array([0, n]), n, seed=100 + n)
        out.append(np.unique(s))
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0] if len(s) else np.uint64(0) for s in sets], np.uint64).view(np.int64)


def _cut(splitter: Splitter, nb: int):
    """(doc_id, text) -> kind 0: a chunk's documents; kind 1: a bucket's (shingle, document) of a chunk."""

    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        ids, sets, size = [], [], 0

        def flush():
            nonlocal ids, sets, size, seq
            number = (task << 32) + seq
            keys, sizes = set_keys(sets), np.array([len(s) for s in sets], np.int64)
            rows = [(0, number, struct.pack("<q", len(ids)) + np.array(ids, np.int64).tobytes() + sizes.tobytes() + keys.tobytes())]
            # a set that the chunk has twice is posted once
            _, one = np.unique(keys, return_index=True)
            one = one[sizes[one] > 0]
            if len(one):
                h = np.concatenate([sets[i] for i in one])
                own = np.repeat(one.astype(np.uint16), sizes[one])
                order = np.argsort(h)
                h, own = h[order], own[order]
                bucket = ((h >> np.uint64(32)) * np.uint64(nb)) >> np.uint64(32)
                cuts = np.searchsorted(bucket, np.arange(nb + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(cuts)):
                    s = slice(cuts[b], cuts[b + 1])
                    rows.append((1, int(b), struct.pack("<qq", number, s.stop - s.start) + _planes(h[s] & MASK40, 5) + own[s].tobytes()))
            ids, sets, size, seq = [], [], 0, seq + 1
            return _rows(rows)

        for b in batches:
            data, offsets = string_buffer(b.column(1))
            own = b.column(0).to_pylist()
            for lo in range(0, len(own), 256):
                hi = min(len(own), lo + 256)
                new = shingle_sets(splitter, data, offsets[lo : hi + 1])
                ids += own[lo:hi]
                sets += new
                size += sum(map(len, new))
                if size >= CHUNK_SHINGLES or len(ids) > 60_000:
                    yield flush()
        if ids:
            yield flush()

    return tidied(run)


def _shared(table: pa.Table) -> pa.Table:
    """One bucket: shingles that two or more sets have -> kind 2 by chunk: (document, token).

    A token is the shingle with the count of its sets in front, so tokens sort from rare to common."""
    kinds, buckets, bodies = (table.column(k).to_pylist() for k in range(3))
    out = [(k, b, x) for k, b, x in zip(kinds, buckets, bodies, strict=True) if k == 0]
    new = [(*struct.unpack_from("<qq", x), x) for k, x in zip(kinds, bodies, strict=True) if k == 1]
    if new:
        bucket = next(b for k, b in zip(kinds, buckets, strict=True) if k == 1)
        chunk = np.repeat(np.array([x[0] for x in new]), [x[1] for x in new])
        h = np.concatenate([_unplanes(x, 16, m, 5) for _, m, x in new])
        own = np.concatenate([np.frombuffer(x, np.uint16, m, 16 + 5 * m) for _, m, x in new])
        order = np.argsort(h, kind="stable")
        s = h[order]
        begin = np.ones(len(s), bool)
        begin[1:] = s[1:] != s[:-1]
        count = np.diff(np.append(np.flatnonzero(begin), len(s)))
        code = np.where(count <= 128, count, np.minimum(255, 128 + 6 * (np.log2(np.maximum(count, 128)) - 7)).astype(np.int64))
        which = np.cumsum(begin) - 1
        keep = count[which] >= 2
        e = order[keep]
        token = (code[which[keep]].astype(np.uint64) << np.uint64(56)) | np.uint64(bucket << 40) | h[e]
        o = np.argsort(chunk[e], kind="stable")
        e, token = e[o], token[o]
        c, cuts = np.unique(chunk[e], return_index=True)
        for number, lo, hi in zip(c, cuts, np.append(cuts[1:], len(e))[: len(c)], strict=True):
            out.append((2, int(number), struct.pack("<q", hi - lo) + own[e[lo:hi]].tobytes() + token[lo:hi].tobytes()))
        del chunk, h, own, order, s, which, e, token, o, new
        tidy()
    return pa.Table.from_batches([_rows(out)])


PREFIX = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def _prefixes(table: pa.Table) -> pa.Table:
    """One chunk: each document with its set's size and key and those of its rarest shingles that others share."""
    kinds, bodies = table.column(0).to_pylist(), table.column(2).to_pylist()
    head = next(x for k, x in zip(kinds, bodies, strict=True) if k == 0)
    (d,) = struct.unpack_from("<q", head)
    ids, n, keys = (np.frombuffer(head, "<i8", d, 8 + 8 * d * j) for j in range(3))
    more = [(struct.unpack_from("<q", x)[0], x) for k, x in zip(kinds, bodies, strict=True) if k == 2]
    cut, token = np.zeros(d + 1, np.int64), np.empty(0, np.uint64)
    if more:
        own = np.concatenate([np.frombuffer(x, np.uint16, m, 8) for m, x in more])
        token = np.concatenate([np.frombuffer(x, np.uint64, m, 8 + 2 * m) for m, x in more])
        order = np.lexsort((token, own))
        own, token = own[order], token[order]
        shared = np.bincount(own, minlength=d)
        most = n - -(-3 * n // 4) + 1 - (n - shared)  # what unshared shingles, the rarest of all, leave of the prefix
        rank = np.arange(len(own)) - (np.cumsum(shared) - shared)[own]
        keep = rank < most[own]
        token = token[keep]
        cut[1:] = np.cumsum(np.bincount(own[keep], minlength=d))
    lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(token.view(np.int64)))
    return pa.table([pa.array(ids), pa.array(n), pa.array(keys), lists], schema=PREFIX)


def width(n: np.ndarray) -> np.ndarray:
    """Groups for sets of ``n`` shingles: a power of two near n / 2, so that a group has few shingles at any size."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 2) / 2)).astype(np.int64), GROUPS, MOST_GROUPS)


def point(s: np.ndarray) -> bytes:
    """Shingles by group; a count of FULL stands for any greater one."""
    g = int(width(np.array([len(s)]))[0])
    return np.minimum(np.bincount((s % np.uint64(g)).astype(np.int64), minlength=g), FULL).astype("<u2").tobytes()


def folded(points: list[bytes], g: int) -> np.ndarray:
    """Points as rows of ``g`` groups: of a point of 2 g groups, halves are added."""
    out = np.empty((len(points), g), np.int64)
    for i, p in enumerate(points):
        v = np.frombuffer(p, "<u2").astype(np.int64)
        out[i] = np.where(v == FULL, 1 << 40, v).reshape(-1, g).sum(0)
    return out


def low_halves(s: np.ndarray) -> bytes:
    """The low 32 bits of the shingles, sorted: half the size, and enough to bound an overlap closely from above."""
    return np.sort(s.astype("<u4")).tobytes()


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles of ``a`` whose low halves ``b`` has too."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _points(splitter: Splitter):
    """(text) -> key, n, point, low, shingles."""

    def run(batches):
        for b in batches:
            data, offsets = string_buffer(b.column(0))
            for lo in range(0, b.num_rows, 256):
                sets = shingle_sets(splitter, data, offsets[lo : min(b.num_rows, lo + 256) + 1])
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(sets)), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([f(s) for s in sets], pa.binary()) for f in (point, low_halves, np.ndarray.tobytes))], ["key", "n", "point", "low", "shingles"])

    return tidied(run)


class Tree:
    """A packed R-tree over count vectors: leaves of ``LEAF`` neighbours in size, nodes of ``LEAF`` leaves."""

    def __init__(self, n: np.ndarray, points: np.ndarray):
        self.order = np.lexsort((points.argmax(1), n))
        self.n, self.points = n[self.order], points[self.order]
        self.levels = []
        top, least = self.points, self.n
        while len(top) > LEAF:
            at = np.arange(0, len(top), LEAF)
            top, least = np.maximum.reduceat(top, at), np.minimum.reduceat(least, at)
            self.levels.append((top, least))

    def search(self, n: int, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries that may link with a set of ``n`` shingles: (number, bound of the overlap)."""
        at = None
        for top, least in reversed(self.levels):
            at = np.arange(len(top)) if at is None else at[at < len(top)]
            bound = np.minimum(top[at], point).sum(1)
            at = at[bound >= needed(n, least[at])]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = np.arange(len(self.n)) if at is None else at[at < len(self.n)]
        bound = np.minimum(self.points[at], point).sum(1)
        ok = bound >= needed(n, self.n[at])
        return self.order[at[ok]], bound[ok]


PAIRS = "a long, b long"


def _groups(batches):
    """Runs of rows with the same first column, across batches."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        t = b.column(0).to_numpy()
        cuts = np.flatnonzero(t[1:] != t[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(t)], strict=True):
            part = b.slice(lo, hi - lo)
            if held and held[0].column(0)[0].as_py() != int(t[lo]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _pairs(found) -> pa.RecordBatch:
    a, b = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in range(2))
    pair = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])


def _to_leader(batches):
    """(tree, key, n, point), sorted by tree and key: pairs of a tree's first class and another that the bound allows."""
    tree = None
    for b in batches:
        t, key, n = (b.column(k).to_numpy() for k in range(3))
        points, found, lo = b.column(3).to_pylist(), [], 0
        while lo < len(t):
            hi = int(np.searchsorted(t, t[lo], "right"))
            if t[lo] != tree:
                tree, leader = t[lo], (key[lo], n[lo], points[lo])
            near = lo + np.flatnonzero((4 * n[lo:hi] >= 3 * leader[1]) & (3 * n[lo:hi] <= 4 * leader[1]) & (key[lo:hi] != leader[0]))
            for g in np.unique(np.minimum(width(n[near]), width(leader[1]))):
                at = near[np.minimum(width(n[near]), width(leader[1])) == g]
                bound = np.minimum(folded([points[i] for i in at], g), folded([leader[2]], g)).sum(1)
                at = at[bound >= needed(n[at], leader[1])]
                found.append((np.full(len(at), leader[0]), key[at]))
            lo = hi
        yield _pairs(found)


def _across(limit: int | None):
    """(cell, key, n, low, label, side): pairs of different components; of blocks, pairs across sides only.

    Links keep sizes within 4 : 3, so a class is searched among points of its own number of groups and the next, folded.
    Pairs that the points allow are bound once more by their low halves, so what is emitted is links but for chance."""

    def search(key, n, low, label, side):
        own = width(n)
        # of two components' members one isn't of the largest, so only those others search
        _, which, many = np.unique(label, return_inverse=True, return_counts=True)
        main = which == many.argmax()
        for g in np.unique(own):
            sel = np.flatnonzero((own == g) | (own == 2 * g))
            if main[sel].all() or len(sel) < 2:
                continue
            lower = own[sel] == g
            x = np.stack([np.bincount(low[i] & np.uint32(g - 1), minlength=g) for i in sel])
            tree = Tree(n[sel], x)
            for i in np.flatnonzero(~main[sel]):
                at, bound = tree.search(int(n[sel[i]]), x[i])
                to, me = sel[at], sel[i]
                ok = (label[to] != label[me]) & (lower[at] | lower[i])
                if side[me] >= 0:
                    ok &= side[to] != side[me]
                if limit is None:
                    ok &= main[to] | (key[to] > key[me])
                to = to[ok][np.argsort(-bound[ok] / (n[to[ok]] + n[me]), kind="stable")]
                good = []
                for j in to:
                    if overlap_bound(low[me], low[j]) >= needed(int(n[me]), int(n[j])):
                        good.append(j)
                        if len(good) == limit:
                            break
                yield np.minimum(key[me], key[good]), np.maximum(key[me], key[good])

    def run(batches):
        found, size = [], 0
        for t in _groups(batches):
            key, n, label, side = (t.column(k).to_numpy() for k in (1, 2, 4, 5))
            if len(key) < 2 or (label == label[0]).all():
                continue
            low = [np.frombuffer(x, "<u4") for x in t.column(3).to_pylist()]
            new = [x for x in search(key, n, low, label, side) if len(x[0])]
            found += new
            size += sum(len(x[0]) for x in new)
            if size > 200_000:
                yield _pairs(found)
                found, size = [], 0
        yield _pairs(found)

    return tidied(run)


def _verify(batches):
    """(a, b, set of a, set of b): those pairs that link."""
    for t in batches:
        a, b = t.column(0).to_numpy(), t.column(1).to_numpy()
        keep = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(t.column(2), t.column(3), strict=True)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            keep[i] = 7 * len(np.intersect1d(x, y, assume_unique=True)) >= 3 * (len(x) + len(y))
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def _links(pairs: DataFrame, points: DataFrame) -> DataFrame:
    one = points.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    two = points.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    return pairs.distinct().join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_verify, PAIRS)


def _cells(members: DataFrame) -> DataFrame:
    """(tree, key, ..., label) -> cells: small trees whole, large ones as pairs of blocks of ``BLOCK``."""
    live = members.groupBy("tree").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    m = members.join(live.select("tree", "size"), "tree").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    small = m.where("blocks = 1").select(F.xxhash64("tree").alias("cell"), "key", "n", "label", F.lit(-1).alias("side"))
    large = m.where("blocks > 1").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), F.lit(-1)).otherwise(F.col("mine"))
    large = large.select(F.xxhash64("tree", lo, hi).alias("cell"), "key", "n", "label", side.alias("side"))
    return small.unionByName(large)


def jaccard_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """-> (doc_id, n, key of the set class) per row with a doc_id; (key, label) of linked classes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    splitter = Splitter(SPACES, fold=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    nb = buckets_for(text_bytes(docs), BUCKET_BYTES)
    parts = docs.mapInArrow(_cut(splitter, nb), ENTRY)
    spread = parts.withColumn("to", F.when(F.col("kind") == 0, -1 - F.col("bucket")).otherwise(F.col("bucket")))
    shared = spread.groupBy("to").applyInArrow(lambda t: _shared(t.select(["kind", "bucket", "body"])), ENTRY)
    rows = scratch.save(shared.groupBy("bucket").applyInArrow(_prefixes, "doc_id long, n long, key long, tokens array<long>"))

    posts = rows.where("size(tokens) > 0").select("key", "n", F.explode("tokens").alias("token")).distinct()
    posts = scratch.save(posts)
    lists = posts.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("key")).alias("h1"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("h2")).where("c > 1")
    trees = lists.groupBy("c", "h1", "h2").agg(F.min("token").alias("token")).select("token")
    members = scratch.save(posts.join(trees, "token", "left_semi").select(F.col("token").alias("tree"), "key", "n"))

    wanted = members.select("key").distinct()
    homes = rows.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    found = docs.join(homes.select("doc_id").distinct(), "doc_id", "left_semi").select("text").mapInArrow(_points(splitter), "key long, n long, point binary, low binary, shingles binary")
    points = scratch.save(found.join(wanted, "key", "left_semi").dropDuplicates(["key"]))

    by_tree = members.join(points.select("key", "point"), "key").select("tree", "key", "n", "point").repartition("tree").sortWithinPartitions("tree", "key")
    # a class tries one leader only; its other trees' leaders are met in the later rounds if that fails
    led = by_tree.mapInArrow(_to_leader, PAIRS).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = scratch.save(_links(led, points))
    labels = scratch.save(components(links, scratch))
    for limit in (LIKELIEST, None):
        now = members.join(labels, "key", "left").select("tree", "key", "n", F.coalesce("label", "key").alias("label"))
        cells = _cells(now).join(points.select("key", "low"), "key").select("cell", "key", "n", "low", "label", "side").repartition("cell").sortWithinPartitions("cell")
        links = scratch.save(_links(cells.mapInArrow(_across(limit), PAIRS), points))
        if links.isEmpty():
            if limit is None:
                break
            continue
        # labels are links, too: of a class to the least of its component
        known = labels.select(F.col("key").alias("a"), F.col("label").alias("b"))
        labels = scratch.save(components(known.unionByName(links), scratch))
    scratch.keep(rows, labels)
    return rows.select("doc_id", "n", "key"), labels


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    rows, labels = jaccard_components(docs)
    label = F.coalesce(F.col("label"), F.col("key"))
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    classes = classes.join(labels, "key", "left").withColumn("label", label)
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = classes.join(least, "label").select("key", "component_id")
    some = rows.where("n > 0").join(ids, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    splitter = Splitter(SPACES, fold=True)

    def sizes(batches):
        for b in batches:
            data, offsets = string_buffer(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingle_sets(splitter, data, offsets)], pa.int64())], ["n_shingles"])

    unnamed = docs.where("doc_id is null").select("text").mapInArrow(sizes, "n_shingles long")
    unnamed = unnamed.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return some.unionByName(none).unionByName(unnamed)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays, that of the least doc_id; so do rows without a doc_id.

    Of a component's repeated rows of that id the first by text stays; an id whose rows are in several components keeps a row of each
    of which it is the least."""
    own = docs.columns
    columns = [F.col(f"`{c}`") for c in own]
    rows, labels = jaccard_components(docs.select("doc_id", "text"))
    # texts without a shingle are components by id
    sets = rows.groupBy("doc_id", "key", "n").agg(F.count("*").alias("c")).join(labels, "key", "left").withColumn("__label", F.when(F.col("n") > 0, F.coalesce("label", "key")))
    least = sets.where("n > 0").groupBy("__label").agg(F.min("doc_id").alias("least"))
    stay = sets.join(least, "__label", "left").where("n = 0 or doc_id = least").select("doc_id", F.col("key").alias("__key"), "__label")
    ids = rows.groupBy("doc_id").agg((F.count("*") > 1).alias("many")).join(stay.select("doc_id", F.lit(True).alias("stays")).distinct(), "doc_id", "left")
    # texts aren't shuffled as long as the ids that go, or are repeated, may be broadcast
    odd = Scratch(docs.sparkSession, "ngram-ids").save(ids.where("many or stays is null").select("doc_id", F.coalesce("stays", F.lit(False)).alias("stays")))
    total, repeated = odd.agg(F.count("*"), F.count_if("stays")).first()
    small = F.broadcast if 24 * total <= BROADCAST_BYTES else (lambda df: df)
    own_id = F.col("doc_id").cast("long")
    name = f"__id_{uuid.uuid4().hex[:8]}"
    single = docs.join(small(odd.select(F.col("doc_id").alias(name))), own_id == F.col(name), "left_anti")
    if not repeated:
        return single.select(*columns)
    splitter, at = Splitter(SPACES, fold=True), own.index("text")

    def keyed(batches):
        for b in batches:
            data, offsets = string_buffer(b.column(at))
            keys = [k for lo in range(0, b.num_rows, 256) for k in set_keys(shingle_sets(splitter, data, offsets[lo : min(b.num_rows, lo + 256) + 1]))]
            yield b.append_column(name, pa.array(keys, pa.int64()))

    # only rows of repeated ids are told apart by their sets
    again = odd.where("stays").select(F.col("doc_id").alias(name))
    many = docs.join(small(again), own_id == F.col(name), "left_semi").select(*columns).mapInArrow(keyed, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
    stay = stay.toDF(*(f"{name}_{c}" for c in stay.columns))
    first = many.join(stay, (own_id == F.col(f"{name}_doc_id")) & (F.col(name) == F.col(f"{name}___key")))
    first = first.withColumn(f"{name}_k", F.row_number().over(Window.partitionBy(f"{name}_doc_id", f"{name}___label").orderBy("text")))
    return single.select(*columns).unionByName(first.where(f"{name}_k = 1").select(*columns))
