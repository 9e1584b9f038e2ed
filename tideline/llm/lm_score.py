"""LM scoring with a hashed maximum-entropy model.

The model gives a token its class, then the token within the class.  The ``CLASSES`` x ``MEMBERS`` most
frequent tokens, in order of frequency, make up the classes; all others share one more class, in which an unseen token has the
smoothed share of a single one, and the known ones are the leaves of a binary tree over the bits of their hashes.  Each branch is
taken by its smoothed share of training tokens and the history.  The tree has about a cell for each known token, up to 2^``MOST_BITS``; tokens
of one cell share it by their exact counts.  So the probabilities of all tokens sum to 1 after any history.  Scores of classes, members
and branches are sums of weights of the history's features (the last token, the last two, the one before the last), hashed into tables.

Counts cover all training tokens and stay distributed by ranges of token hashes; the ``TOP`` most frequent are broadcast,
which fixes the size.  Rarer tokens of a text meet their counts in the range's task, and only sums by text come back.  Training goes over all
training texts, in ``ROUNDS`` parts: rows are dealt by their hash into shards of about ``SHARD_BYTES``, each in a fixed order, so the model doesn't
depend on how the input is partitioned.  A task takes gradient steps over one shard from the same weights as all others, and the changes
are averaged row by row, weighted by the tokens that touched the row, up a tree of tasks.

Defined cases: a null or empty text is the end token alone; without training rows nothing is known and every count
is 0; a null doc_id is learned from; repeated rows count and are scored one by one; other columns aren't read.
"""

from __future__ import annotations

import copy
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, buckets_for, text_bytes
from tideline.llm.substring_dedup import ENTRY, _planes, _rows, _unplanes
from tideline.llm.textkernel import SPACES, Splitter, mix, string_buffer

CLASSES, MEMBERS = 32, 64
CLASS_ROWS, MEMBER_ROWS = 1 << 12, 1 << 13
TOP = 1 << 17
ROUNDS, STEP, BRANCH_STEP, RATE = 2, 1 << 13, 1 << 14, 0.15
MOST_BITS = 22
BRANCH_BITS = 16, 19  # of the table of branches: least, most
SHARD_BYTES, LEAST_SHARDS = 16 << 20, 8
BUCKET_BYTES = 24 << 20
CHUNK_TOKENS = 1 << 20
FAN_IN = 8
STOP = np.uint64(0xFFFFFFFFFFFFFFF1)
START = np.uint64(0x5151515151515151)
MASK40 = np.uint64((1 << 40) - 1)
ALPHA = 0.1


def tokens(splitter: Splitter, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's words and its end token, where each text's begin)."""
    h, _, _, first = splitter.words(data, offsets)
    begin = first + np.arange(len(first))
    out = np.full(int(begin[-1]), STOP, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = h
    return out, begin


def _bucket(h: np.ndarray, nb: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(nb)) >> np.uint64(32)


def _blocks(batches, column: int, docs: int = 512):
    for b in batches:
        data, offsets = string_buffer(b.column(column))
        for lo in range(0, b.num_rows, docs):
            at = offsets[lo : min(b.num_rows, lo + docs) + 1]
            yield b.slice(lo, len(at) - 1), data[at[0] : at[-1]], at - at[0]


def _count(splitter: Splitter, nb: int):
    """text -> kind 1: (tokens, counts) of a bucket in a chunk."""

    def run(batches):
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(_bucket(h, nb), np.arange(nb + 1, dtype=np.uint64))
            return _rows([(1, int(b), struct.pack("<q", cuts[b + 1] - cuts[b]) + h[cuts[b] : cuts[b + 1]].tobytes() + n[cuts[b] : cuts[b + 1]].astype(np.uint32).tobytes()) for b in np.flatnonzero(np.diff(cuts))])

        for _, data, offsets in _blocks(batches, 0):
            h, _ = tokens(splitter, data, offsets)
            held.append(h)
            size += len(h)
            if size >= CHUNK_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _summed(nb: int):
    """One bucket -> kind 2: its tokens and counts; kind 3: totals; kind 4: its most frequent.

    Hashes spread frequent tokens evenly, so four times a bucket's share of ``TOP`` are handed on; were one missed, it
    would count as rare, which changes where its count is looked up, not what it is."""
    most = -(-4 * TOP // nb)

    def run(table: pa.Table) -> pa.Table:
        parts = [(struct.unpack_from("<q", x)[0], x) for x in table.column("body").to_pylist()]
        h = np.concatenate([np.frombuffer(x, np.uint64, m, 8) for m, x in parts])
        n = np.concatenate([np.frombuffer(x, np.uint32, m, 8 + 8 * m) for m, x in parts])
        h, inverse = np.unique(h, return_inverse=True)
        n = np.bincount(inverse, n, len(h)).astype(np.int64)
        b = table.column("bucket")[0].as_py()
        top = np.lexsort((h, -n))[:most]
        return pa.Table.from_batches([_rows([
            (2, b, struct.pack("<q", len(h)) + h.tobytes() + n.tobytes()), (3, b, struct.pack("<qq", n.sum(), len(h))), (4, b, h[top].tobytes() + n[top].tobytes()),
        ])])

    return run


def _top_rows(batches):
    for b in batches:
        for body in b.column(0).to_pylist():
            m = len(body) // 16
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(body, np.int64, m)), pa.array(np.frombuffer(body, np.int64, m, 8 * m))], ["h", "n"])


@dataclass
class Vocabulary:
    total: int
    distinct: int
    top: np.ndarray  # sorted hashes of the TOP most frequent
    counts: np.ndarray
    place: np.ndarray  # class * MEMBERS + member; -1 outside the classes
    cells: np.ndarray = field(default_factory=lambda: np.zeros(2, np.float32))  # smoothed training tokens outside the classes, by the first bits of their hashes

    @property
    def rest(self) -> tuple[int, int]:
        """Tokens and distinct tokens outside the classes."""
        own = self.place >= 0
        return self.total - int(self.counts[own].sum()), self.distinct - int(own.sum())

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, or -1 where it isn't known here; place)"""
        if not len(self.top):
            return np.full(len(h), -1), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.top, h), len(self.top) - 1)
        same = self.top[at] == h
        return np.where(same, self.counts[at], -1), np.where(same, self.place[at], -1)


def _cells(own: np.ndarray, bits: int):
    """kind 2 -> smoothed counts of the tokens not in ``own``, by cells from ``first`` on."""

    def run(batches):
        for b in batches:
            for body in b.column(0).to_pylist():
                (m,) = struct.unpack_from("<q", body)
                h, n = np.frombuffer(body, np.uint64, m, 8), np.frombuffer(body, np.int64, m, 8 + 8 * m)
                rest = ~np.isin(h, own)
                cell = (h[rest] >> np.uint64(64 - bits)).astype(np.int64)
                if len(cell):
                    mass = np.bincount(cell - cell[0], n[rest] + ALPHA).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[0])]), pa.array([mass.tobytes()])], ["first", "mass"])

    return run


def vocabulary(counted: DataFrame) -> Vocabulary:
    sums = counted.where("kind = 3").select("body")
    one = sums.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([struct.unpack("<qq", x)[k] for x in b.column(0).to_pylist()], pa.int64()) for k in (0, 1)], ["n", "v"]) for b in bs), "n long, v long")
    row = one.agg(F.sum("n"), F.sum("v")).first()
    total, distinct = row[0] or 0, row[1] or 0
    best = counted.where("kind = 4").select("body").mapInArrow(_top_rows, "h long, n long").orderBy(F.desc("n"), "h").limit(TOP).toArrow()
    h, n = best.column("h").to_numpy().view(np.uint64), best.column("n").to_numpy()
    place = np.where(np.arange(len(h)) < CLASSES * MEMBERS, np.arange(len(h)), -1)
    order = np.argsort(h)
    voc = Vocabulary(total, distinct, h[order], n[order], place[order])
    if voc.rest[1]:
        bits = min(MOST_BITS, max(1, (voc.rest[1] - 1).bit_length()))
        voc.cells = np.zeros(1 << bits, np.float32)
        # ranges of buckets may share a cell at their ends
        for row in counted.where("kind = 2").select("body").mapInArrow(_cells(voc.top[voc.place >= 0], bits), "first long, mass binary").orderBy("first", F.length("mass")).collect():
            mass = np.frombuffer(row["mass"], np.float32)
            voc.cells[row["first"] : row["first"] + len(mass)] += mass
    return voc


class Model:
    """Weights: class tables have one more class, the last, for all other tokens."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        of = np.zeros(CLASSES * MEMBERS)
        own = v.place >= 0
        of[v.place[own]] = v.counts[own]
        by_class = of.reshape(CLASSES, MEMBERS)
        self.classes = np.zeros((CLASS_ROWS, CLASSES + 1), np.float32)
        self.members = np.zeros((MEMBER_ROWS, MEMBERS), np.float32)
        # an empty place can't be drawn: its bias is -inf in effect
        self.class_bias = np.log(np.append(by_class.sum(1), v.rest[0] + ALPHA * (v.rest[1] + 1)) + 1e-12).astype(np.float32)
        self.class_bias -= self.class_bias.max()
        self.class_bias[:-1][by_class.sum(1) == 0] = -1e4
        self.member_bias = np.where(by_class > 0, np.log(np.maximum(by_class, 1)), -1e4).astype(np.float32)
        # branch k leads to 2k and 2k + 1; where only one of them has tokens, it is as good as certain
        self.bits = len(v.cells).bit_length() - 1
        self.branches = np.zeros(1 << min(max(self.bits, BRANCH_BITS[0]), BRANCH_BITS[1]), np.float32)
        self.branch_bias = np.zeros(len(v.cells), np.float32)
        mass = v.cells.astype(float)
        self.known = mass.sum()
        while len(mass) > 1:
            mass = mass.reshape(-1, 2)
            self.branch_bias[len(mass) : 2 * len(mass)] = np.where(mass.all(1), np.diff(np.log(np.maximum(mass, 1e-9)))[:, 0], 40 * np.diff(np.sign(mass))[:, 0])
            mass = mass.sum(1)


def histories(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Three feature hashes for each token."""
    one, two = np.full(len(h), START, np.uint64), np.full(len(h), START, np.uint64)
    one[1:] = h[:-1]
    one[begin[:-1]] = START
    two[1:] = one[:-1]
    two[begin[:-1]] = START
    with np.errstate(over="ignore"):
        return np.stack([mix(one), mix(one * np.uint64(0x9E3779B97F4A7C15) + two), mix(two ^ np.uint64(0x2545F4914F6CDD1D))])


def _exps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of each row less what it is shifted by, which is 0 unless exp leaves the range of floats; sums of rows; shifts."""
    with np.errstate(over="ignore"):
        e = np.exp(x)
        total, shift = np.einsum("ij->i", e), np.zeros(len(x), np.float32)
    if len(far := np.flatnonzero(~((total > 1e-30) & (total < 1e30)))):
        shift[far] = x[far].max(1)
        e[far] = np.exp(x[far] - shift[far, None])
        total[far] = np.einsum("ij->i", e[far])
    return e, total, shift


def log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log of softmax(x) at one column of each row."""
    _, total, shift = _exps(x)
    return x[np.arange(len(x)), at] - shift - np.log(total)


def _softmax(x: np.ndarray) -> np.ndarray:
    e, total, _ = _exps(x)
    e /= total[:, None]
    return e


def scores(model: Model, rows: np.ndarray, place: np.ndarray):
    """Scores of all classes with their table rows; and of the tokens in classes: which, their class, table rows, member scores."""
    c = (rows & np.uint64(CLASS_ROWS - 1)).astype(np.uint16)
    classes = model.classes.take(c[0], 0)
    classes += model.classes.take(c[1], 0)
    classes += model.classes.take(c[2], 0)
    classes += model.class_bias
    some = np.flatnonzero(place >= 0)
    k = place[some] // MEMBERS
    with np.errstate(over="ignore"):
        m = (mix(rows[:, some] + k.astype(np.uint64)) & np.uint64(MEMBER_ROWS - 1)).astype(np.uint16)
    members = model.members.take(m[0], 0)
    members += model.members.take(m[1], 0)
    members += model.members.take(m[2], 0)
    members += model.member_bias.take(k, 0)
    return classes, c, some, k, m, members


def branches(model: Model, rows: np.ndarray, h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The branches on the ways to the cells of ``h``, by depth and token: places in the table, whether the second side is taken, its log odds."""
    d = np.arange(model.bits, dtype=np.uint64)[:, None]
    node = h >> np.uint64(1) >> (np.uint64(63) - d)
    node |= np.uint64(1) << d
    taken = (h >> (np.uint64(63) - d) & np.uint64(1)).astype(bool)
    odds = model.branch_bias.take(node.view(np.int64))
    shift = np.uint64(65 - len(model.branches).bit_length())
    places = []
    with np.errstate(over="ignore"):
        node *= np.uint64(0x9E3779B97F4A7C15)
        for f in rows:
            x = node ^ f
            x *= np.uint64(0xD6E8FEB86659FD93)
            x >>= shift
            places.append(x.view(np.int64))
            odds += model.branches.take(places[-1])
    return places, taken, odds


def log_known(model: Model, cells: np.ndarray, rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """log of what the history makes of the share of a known token outside the classes: P(cell) by P(cell) without a history."""
    out = np.zeros(len(h))
    for lo in range(0, len(h), STEP):
        s = slice(lo, lo + STEP)
        _, taken, odds = branches(model, rows[:, s], h[s])
        odds *= 1 - 2 * taken.astype(np.float32)
        np.minimum(odds, 80, out=odds)
        np.exp(odds, out=odds)
        odds += 1
        np.log(odds, out=odds)
        mass = cells.take((h[s] >> np.uint64(64 - model.bits)).astype(np.int64)).astype(float)
        some = mass > 0  # in an empty cell nothing is known
        out[s][some] = np.log(model.known) - np.log(mass[some]) - odds.sum(0, dtype=float)[some]
    return out


def log_probabilities(model: Model, h: np.ndarray, begin: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Natural logarithm of P(class) or P(class) P(member) of each token."""
    rows, out = histories(h, begin), np.empty(len(h))
    for lo in range(0, len(h), STEP):
        s = slice(lo, lo + STEP)
        classes, _, some, k, _, members = scores(model, rows[:, s], place[s])
        mine = np.full(len(classes), CLASSES)
        mine[some] = k
        part = log_share(classes, mine).astype(float)
        if len(some):
            part[some] += log_share(members, place[s][some] % MEMBERS)
        out[s] = part
    return out


def row_sums(rows: np.ndarray, values: np.ndarray, near: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, sums of ``values`` by row, how many) for some sets of ``rows``, each as long as ``values``."""
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    cut = np.flatnonzero(np.diff(s.astype(np.int32), prepend=-1))
    n = np.diff(cut, append=len(s))
    by_size = np.argsort(-n, kind="stable")
    cut, n = cut[by_size], n[by_size]
    order %= len(values)
    sums = values.take(order[cut], 0)
    for k in range(1, near):  # the k-th of every row that has one: few steps over many rows
        m = int(np.searchsorted(-n, -k, "left"))
        sums[:m] += values.take(order[cut[:m] + k], 0)
    if m := int(np.searchsorted(-n, -near, "left")):
        left = n[:m] - near
        begin = np.cumsum(left) - left
        sums[:m] += np.add.reduceat(values.take(order[np.repeat(cut[:m] + near - begin, left) + np.arange(left.sum())], 0), begin, axis=0)
    return s[cut], sums, n


class _Table:
    """Adagrad on the touched rows of one table."""

    def __init__(self, weights: np.ndarray):
        self.start, self.weights = weights.copy(), weights
        self.total = np.full(weights.shape, 1e-2, np.float32)
        self.seen = np.zeros(len(weights), np.int64)

    def step(self, rows: np.ndarray, grad: np.ndarray) -> None:
        at, g, n = row_sums(rows, grad)
        total = self.total.take(at, 0)
        total += g * g
        self.total[at] = total
        np.sqrt(total, out=total)
        g *= RATE
        g /= total
        self.weights[at] -= g
        self.seen[at] += n

    def change(self) -> bytes:
        n = self.seen.astype(np.float32)
        return ((self.weights - self.start) * n[:, None]).astype(np.float32).tobytes() + n.tobytes()


class _Branches:
    """Adagrad on single weights; a change weighs by its squared gradients."""

    def __init__(self, weights: np.ndarray):
        self.start, self.weights = weights.copy(), weights
        self.total = np.zeros(weights.shape, np.float32)

    def step(self, places: list[np.ndarray], grad: np.ndarray) -> None:
        grad = grad.ravel().astype(float)
        g = sum(np.bincount(at.ravel(), grad, len(self.weights)) for at in places).astype(np.float32)
        self.total += g * g
        g *= np.float32(RATE)
        g /= np.sqrt(self.total + np.float32(1e-2))
        self.weights -= g

    def change(self) -> bytes:
        return ((self.weights - self.start) * self.total).tobytes() + self.total.tobytes()


def _learn(splitter: Splitter, shared):
    """text -> the changes of one shard: kind 0 of classes, 1 of members, 2 of branches; bucket is the shard, which is the task."""

    def run(batches):
        voc, model = shared.value
        model = copy.copy(model)  # a worker keeps what was broadcast for its next tasks, so that may not change
        model.classes, model.members, model.branches = model.classes.copy(), model.members.copy(), model.branches.copy()
        tables = _Table(model.classes), _Table(model.members), _Branches(model.branches)
        for _, data, offsets in _blocks(batches, 0):
            h, begin = tokens(splitter, data, offsets)
            rows, (_, place) = histories(h, begin), voc.look_up(h)
            for lo in range(0, len(h), STEP):
                s = slice(lo, lo + STEP)
                classes, c, some, k, m, members = scores(model, rows[:, s], place[s])
                mine = np.full(len(classes), CLASSES)
                mine[some] = k
                grad = _softmax(classes)
                grad[np.arange(len(grad)), mine] -= 1
                tables[0].step(c, grad)
                if len(some):
                    grad = _softmax(members)
                    grad[np.arange(len(grad)), place[s][some] % MEMBERS] -= 1
                    tables[1].step(m, grad)
            rest = np.flatnonzero(place < 0)
            for lo in range(0, len(rest), BRANCH_STEP):
                s = rest[lo : lo + BRANCH_STEP]
                places, taken, odds = branches(model, rows[:, s], h[s])
                np.minimum(np.negative(odds, out=odds), 80, out=odds)
                np.exp(odds, out=odds)
                odds += 1
                np.divide(1, odds, out=odds)
                odds -= taken
                tables[2].step(places, odds)
        yield _rows([(kind, TaskContext.get().partitionId(), t.change()) for kind, t in enumerate(tables)])

    return run


def _add(table: pa.Table) -> pa.Table:
    """Sums of weighted changes and weights, in the order of shards; one step up the tree."""
    total = None
    for i in np.argsort(table.column("bucket").to_numpy()):
        v = np.frombuffer(table.column("body")[int(i)].as_buffer(), np.float32)
        total = v.copy() if total is None else total + v
    return pa.Table.from_batches([_rows([(table.column("kind")[0].as_py(), table.column("node")[0].as_py(), total.tobytes())])])


def train(texts: DataFrame, voc: Vocabulary, splitter: Splitter, shards: int) -> Model:
    """texts (text, part): ``part`` is a hash of the row; it gives the round, the shard and the order within."""
    spark, model = texts.sparkSession, Model(voc)
    if not voc.total:
        return model
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast((voc, model))
        part = texts.where(F.pmod(F.col("part"), F.lit(ROUNDS)) == r)
        dealt = part.repartitionById(shards, F.pmod(F.shiftright("part", 8), F.lit(shards)).cast("int")).sortWithinPartitions("part", "text")
        changes, left = dealt.select("text").mapInArrow(_learn(splitter, shared), ENTRY), shards
        while left > 1:
            changes = changes.withColumn("node", F.floor(F.col("bucket") / FAN_IN)).groupBy("kind", "node").applyInArrow(_add, ENTRY)
            left = -(-left // FAN_IN)
        for row in changes.collect():  # one row a table
            table = (model.classes, model.members, model.branches)[row["kind"]]
            v = np.frombuffer(row["body"], np.float32)
            n = v[table.size :]
            table += v[: table.size].reshape(table.shape) / np.where(n > 0, n, 1).reshape(-1, *[1] * (table.ndim - 1))
        shared.unpersist()
    return model


_DOC = [("has_id", np.uint8), ("doc_id", np.int64), ("held_out", np.uint8), ("n_tokens", np.int64), ("n_known", np.int64), ("base", np.float64), ("model", np.float64), ("rest", np.int64)]


def _score(splitter: Splitter, nb: int, shared):
    """(doc_id, held_out, text) -> kind 0: a chunk's texts with what is known here; kind 1: (rare token, text, what the history makes of its share) of a bucket."""

    def run(batches):
        voc, model = shared.value
        task, seq = TaskContext.get().partitionId(), 0
        docs, rare, owner, ways, size, count = [], [], [], [], 0, 0

        def flush():
            number = (task << 32) + seq
            columns = [np.concatenate([d[k] for d in docs]) for k in range(len(_DOC))]
            rows = [(0, number, struct.pack("<q", count) + b"".join(c.astype(t).tobytes() for c, (_, t) in zip(columns, _DOC, strict=True)))]
            h, own, way = np.concatenate(rare), np.concatenate(owner), np.concatenate(ways)
            order = np.argsort(h, kind="stable")
            h, own, way = h[order], own[order].astype(np.uint16), way[order].astype(np.float32)
            cuts = np.searchsorted(_bucket(h, nb), np.arange(nb + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(cuts)):
                s = slice(cuts[b], cuts[b + 1])
                rows.append((1, int(b), struct.pack("<qq", number, s.stop - s.start) + _planes(h[s], 8) + own[s].tobytes() + way[s].tobytes()))
            return _rows(rows)

        for b, data, offsets in _blocks(batches, 2):
            h, begin = tokens(splitter, data, offsets)
            n, place = voc.look_up(h)
            logs = log_probabilities(model, h, begin, place) / np.log(10)
            known, out = n > 0, place < 0
            rest, way = np.flatnonzero(out), np.zeros(len(h))
            way[rest] = log_known(model, voc.cells, histories(h, begin)[:, rest], h[rest]) / np.log(10)
            by = lambda x: np.add.reduceat(x, begin[:-1])
            smooth = np.where(known, np.log10(np.maximum(n, 0) + ALPHA), 0)
            ids = b.column(0)
            docs.append((~np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), np.diff(begin), by(known.astype(np.int64)), by(smooth), by(logs + np.where(out & known, smooth + way, 0)), by(out.astype(np.int64))))
            unknown = np.flatnonzero(~known)
            rare.append(h[unknown])
            owner.append(count + np.searchsorted(begin, unknown, "right") - 1)
            ways.append(way[unknown])
            count, size = count + len(begin) - 1, size + len(h)
            if size >= CHUNK_TOKENS or count > 60_000:
                yield flush()
                docs, rare, owner, ways, size, count, seq = [], [], [], [], 0, 0, seq + 1
        if docs:
            yield flush()

    return run


def _answer(table: pa.Table) -> pa.Table:
    """One bucket's counts (kind 2) for its rare tokens (kind 1) -> kind 5: sums by text of a chunk."""
    kinds, buckets, bodies = (table.column(k).to_pylist() for k in ("kind", "bucket", "body"))
    out = [(k, b, x) for k, b, x in zip(kinds, buckets, bodies, strict=True) if k == 0]
    h, n = np.empty(0, np.uint64), np.empty(0, np.int64)
    for k, x in zip(kinds, bodies, strict=True):
        if k == 2:
            (m,) = struct.unpack_from("<q", x)
            h, n = np.frombuffer(x, np.uint64, m, 8), np.frombuffer(x, np.int64, m, 8 + 8 * m)
    for k, x in zip(kinds, bodies, strict=True):
        if k == 1:
            number, m = struct.unpack_from("<qq", x)
            asked, own = _unplanes(x, 16, m, 8), np.frombuffer(x, np.uint16, m, 16 + 8 * m)
            way = np.frombuffer(x, np.float32, m, 16 + 10 * m)
            count = np.zeros(m, np.int64)
            if len(h):
                at = np.minimum(np.searchsorted(h, asked), len(h) - 1)
                count = np.where(h[at] == asked, n[at], 0)
            texts, inverse = np.unique(own, return_inverse=True)
            known, logs = np.bincount(inverse, count > 0).astype(np.int32), np.bincount(inverse, np.log10(count + ALPHA))
            more = np.bincount(inverse, np.where(count > 0, way, 0))
            out.append((5, number, struct.pack("<q", len(texts)) + texts.tobytes() + known.tobytes() + logs.tobytes() + more.tobytes()))
    return pa.Table.from_batches([_rows(out)])


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(total: int, distinct: int, rest: tuple[int, int]):
    all_log = np.log10(total + ALPHA * (distinct + 1))
    rest_log = np.log10(rest[0] + ALPHA * (rest[1] + 1))

    def run(table: pa.Table) -> pa.Table:
        kinds, bodies = table.column("kind").to_pylist(), table.column("body").to_pylist()
        head = next(x for k, x in zip(kinds, bodies, strict=True) if k == 0)
        (m,) = struct.unpack_from("<q", head)
        v, at = {}, 8
        for name, t in _DOC:
            v[name] = np.frombuffer(head, t, m, at).copy()
            at += m * np.dtype(t).itemsize
        for k, x in zip(kinds, bodies, strict=True):
            if k == 5:
                (c,) = struct.unpack_from("<q", x)
                texts = np.frombuffer(x, np.uint16, c, 8)
                logs = np.frombuffer(x, np.float64, c, 8 + 6 * c)
                v["n_known"][texts] += np.frombuffer(x, np.int32, c, 8 + 2 * c)
                v["base"][texts] += logs
                v["model"][texts] += logs + np.frombuffer(x, np.float64, c, 8 + 14 * c)  # rare tokens are outside the classes
        base = v["base"] - v["n_tokens"] * all_log
        score = v["model"] - v["rest"] * rest_log
        ids = pa.array(v["doc_id"], mask=v["has_id"] == 0)
        return pa.table([ids, pa.array(v["held_out"] != 0), pa.array(v["n_tokens"]), pa.array(v["n_known"]), pa.array(np.full(m, total)), pa.array(base), pa.array(score)], names=[x.split()[0] for x in OUT.split(", ")])

    return run


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = text_bytes(rows)
    nb = buckets_for(size, BUCKET_BYTES)
    splitter = Splitter(SPACES, fold=True)
    learn = rows.where("not held_out").select("text", F.xxhash64("doc_id", "text").alias("part"))
    counted = scratch.save(learn.select("text").mapInArrow(_count(splitter, nb), ENTRY).groupBy("bucket").applyInArrow(_summed(nb), ENTRY))
    voc = vocabulary(counted)
    model = train(learn, voc, splitter, buckets_for(size, SHARD_BYTES, LEAST_SHARDS))
    shared = spark.sparkContext.broadcast((voc, model))
    asked = rows.mapInArrow(_score(splitter, nb, shared), ENTRY).unionByName(counted.where("kind = 2"))
    key = F.when(F.col("kind") == 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    answers = asked.withColumn("key", key).groupBy("key").applyInArrow(_answer, ENTRY)
    answers = answers.where("kind in (0, 5)")
    return answers.groupBy("bucket").applyInArrow(_finish(voc.total, voc.distinct, voc.rest), OUT)
