"""Substring dedup with a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words.  Of the 5-word grams in a window the one with the least hash is
its anchor, so equal windows have equal anchors, and neighbouring windows mostly share one.  An entry is an
anchor's hash with a hash of each whole window that it anchors, and where in which document it stands.

The index is a table in the shared folder that is bucketed by ranges of anchor hashes.  A run is one row a bucket, its
entries in sorted order, and is never changed.  A new batch, all of whose ids are greater than those indexed, is cut into the same buckets and
merge-joined with the runs bucket by bucket; the runs are read where they lie, and only the batch is shuffled.  Windows that
the runs hold, or a smaller id of the batch, are hits; entries new to the index make up the next run.  At
``FAN_IN`` runs ``compact`` merges them into one.  ``FingerprintIndex.open`` takes up a written index again.

A hit is a claim: words of this document stand in that one, too.  ``verified`` compares the words of both, by a
128-bit digest of each claimed passage; passages that differ, which share hashes by chance, are settled exactly by their words.

Within a chunk of documents an entry is sent once, whatever copies the chunk holds, so an entry shared by many documents is one
in a chunk and one in a run.

Defined cases: a null or empty text has no words; texts under 13 words lose nothing; a repeat inside one
document, or in rows of the same id, is no duplicate; a null id counts as greater than all others (and as equal to 2**63 - 1);
repeated rows get one result each; texts of any length are cut into chunks by words; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, buckets_for, text_bytes
from tideline.llm.textkernel import SPACES, Splitter, mix, string_buffer, tidied, tidy, windows

WINDOW, GRAM = 13, 5
SIDE = WINDOW - GRAM
FAN_IN = 2
BATCHES = 3
BUCKET_BYTES, FINE_BUCKETS, LARGE_BUCKET_BYTES = 2 << 20, 4096, 6 << 20
TABLE_BUCKETS = 1024
CHUNK_WORDS = 1 << 18
BLOCK_BYTES = 1 << 20
#: Claims are cut at multiples of this place in the older document, so that few different passages are asked of it.
CLAIM = 64
BROADCAST_BYTES = 24 << 20
KNOWN_HASHES = 1 << 20
LAST = (1 << 63) - 1
WINDOW_BITS = 40
MASK40 = np.uint64((1 << 40) - 1)
ENTRY = "kind int, bucket long, body binary"
CUT = "bucket long, chunk long, body binary"
RUN = "run int, bucket long, body binary, hits array<struct<chunk:long,body:binary>>"
CLAIMS = "doc long, mark long, start long, n long, rep_doc long, rep_start long"


def _anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each window's anchor is, by the window's start (leftmost of equals), and the grams' hashes."""
    gram, _ = windows(hashes, np.array([0, len(hashes)]), GRAM, seed=3)
    # sliding minimum over the SIDE + 1 grams of a window
    key, at, size = gram, np.arange(len(gram), dtype=np.int32), 1
    while size < SIDE + 1:
        d = min(size, SIDE + 1 - size)
        take = key[d:] < key[: len(key) - d]
        at = np.where(take, at[d:], at[: len(at) - d])
        key = np.where(take, key[d:], key[: len(key) - d])
        size += d
    return at, gram


def _order(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the parts that begin at ``starts``, one part behind the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _planes(x: np.ndarray, n: int) -> bytes:
    """Low ``n`` bytes of each number, byte by byte: sorted numbers compress well so."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _unplanes(body: bytes, at: int, m: int, n: int) -> np.ndarray:
    out = np.zeros((m, 8), np.uint8)
    out[:, :n] = np.frombuffer(body, np.uint8, m * n, at).reshape(n, m).T
    return out.view("<u8").ravel()


def _pack(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Columns of whole numbers, each by its low bytes, behind their length."""
    return struct.pack("<q", len(columns[0][0])) + b"".join(_planes(x.astype(np.int64).view(np.uint64), n) for x, n in columns)


def _unpack(body: bytes, at: int, widths: tuple[int, ...]) -> tuple[list[np.ndarray], int]:
    """(columns, where they end)"""
    (m,) = struct.unpack_from("<q", body, at)
    at, out = at + 8, []
    for n in widths:
        out.append(_unplanes(body, at, m, n).view(np.int64))
        at += m * n
    return out, at


def _concat(parts: list[list[np.ndarray]], k: int) -> np.ndarray:
    return np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64)


#: Bytes of an entry's columns: anchor hash, windows, document (less the least), place of the first window; in a batch's also the number in the chunk.
OLD, NEW = (5, 1, 8, 5), (5, 1, 8, 5, 3)
#: Bytes of a hit's columns: number in the chunk, place, windows, older document, place there.
HIT = (3, 5, 5, 8, 5)


def _windows_hash(whole: np.ndarray) -> np.ndarray:
    return whole & np.uint64((1 << WINDOW_BITS) - 1)


def _pack_entries(h, many, doc, place, whole, number=None) -> bytes:
    columns = [(h, 5), (many, 1), (doc, 8), (place, 5)] + ([] if number is None else [(number, 3)])
    return _pack(columns) + _pack([(whole, 5)])


def _unpack_entries(body: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    columns, at = _unpack(body, 0, widths)
    (whole,), _ = _unpack(body, at, (5,))
    return [*columns, whole]


def _entry_keys(h: np.ndarray, many: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """One hash of each entry's anchor and windows in order."""
    with np.errstate(over="ignore"):
        begin = np.cumsum(many) - many
        step = np.arange(len(whole)) - np.repeat(begin, many)
        x = mix(whole.astype(np.uint64) + mix(step.astype(np.uint64) + np.uint64(77)))
        sums = np.zeros(len(whole) + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        return mix(h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (sums[begin + many] - sums[begin]) * np.uint64(2) + many.astype(np.uint64))


def _runs(doc_key: np.ndarray, place: np.ndarray, rep_doc: np.ndarray, rep_place: np.ndarray) -> np.ndarray:
    """Where runs of neighbours begin: the same documents, and places that count up in both."""
    new = np.ones(len(place), bool)
    if len(place) > 1:
        new[1:] = (doc_key[1:] != doc_key[:-1]) | (place[1:] != place[:-1] + 1) | (rep_doc[1:] != rep_doc[:-1]) | (rep_place[1:] != rep_place[:-1] + 1)
    return np.flatnonzero(new)


def _chunk_rows(chunk: int, doc: np.ndarray, mark: np.ndarray, base: np.ndarray, hashes: np.ndarray, counts: np.ndarray, nb: int):
    """The rows (bucket, chunk, body) of one chunk: its parts of documents under bucket -1 - chunk, then the entries of each bucket.

    ``base`` is the word of its document with which a part begins."""
    first = np.concatenate([[0], np.cumsum(counts)])
    whole, pos = windows(hashes, first, WINDOW)
    same, rows = [[np.empty(0, np.int64)] * 5], []
    if len(pos):
        whole = _windows_hash(whole)
        anchor, gram = _anchors(hashes)
        anchor = anchor[pos]
        owner = np.searchsorted(first, pos, "right") - 1
        begin = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))  # windows of one anchor follow each other
        many = np.diff(begin, append=len(anchor))
        h = gram[anchor[begin]]
        owner = owner[begin]
        place = pos[begin] - first[owner] + base[owner]
        bucket = (((h >> np.uint64(32)) * np.uint64(nb)) >> np.uint64(32)).astype(np.int64)
        h = (h & MASK40).astype(np.int64)
        # an entry that the chunk has before is the same as that: what holds of the first holds of it
        key = _entry_keys(h, many, whole) ^ bucket.astype(np.uint64)
        order = np.lexsort((place, owner, doc[owner], key))
        lead = np.ones(len(order), bool)
        lead[1:] = key[order[1:]] != key[order[:-1]]
        leader = order[lead][np.cumsum(lead) - 1]
        rest = order[~lead]
        to = leader[~lead]
        same = [[owner[rest], place[rest], many[rest], owner[to], place[to]]]
        keep = order[lead]
        keep = keep[np.lexsort((h[keep], bucket[keep]))]
        cuts = np.searchsorted(bucket[keep], np.arange(nb + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            e = keep[cuts[b] : cuts[b + 1]]
            rows.append((int(b), chunk, _pack_entries(h[e], many[e], doc[owner[e]], place[e], whole[_order(begin[e], many[e])], owner[e])))
    yield -1 - chunk, chunk, b"H" + _pack([(doc, 8), (mark, 8)]) + _pack([(x, w) for x, w in zip(same[0], (3, 5, 1, 3, 5), strict=True)])
    yield from rows


def _parts(splitter: Splitter, data: np.ndarray, offsets: np.ndarray):
    """(first row, rows, word hashes, words by row, first word of the row's part): about ``BLOCK_BYTES`` at a time.

    Longer texts come in parts, each with the last words of the one before."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1)
        if offsets[hi] - offsets[lo] <= 2 * BLOCK_BYTES:
            h, _, _, first = splitter.words(data, offsets[lo : hi + 1])
            yield lo, hi - lo, h, np.diff(first), np.zeros(hi - lo, np.int64)
        else:
            at, end, carry, base = int(offsets[lo]), int(offsets[hi]), np.empty(0, np.uint64), 0
            while at < end:
                stop = splitter.cut(data, at, end, BLOCK_BYTES)
                h, _, _, _ = splitter.words(data, np.array([at, stop]))
                h = np.concatenate([carry, h])
                yield lo, 1, h, np.array([len(h)]), np.array([base])
                carry = h[max(0, len(h) - WINDOW + 1) :]
                base, at = base + len(h) - len(carry), stop
        lo = hi


def _cutter(nb: int, splitter: Splitter):
    """Documents (doc, mark, text) to the rows of chunks of ``CHUNK_WORDS`` words."""

    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            nonlocal held, size, seq
            doc, mark, counts, base = (np.concatenate([x[k] for x in held]) for k in (0, 1, 3, 4))
            hashes = np.concatenate([x[2] for x in held])
            held, size = [], 0
            rows = list(_chunk_rows((task << 32) + seq, doc, mark, base, hashes, counts, nb))
            seq += 1
            bucket, chunk, body = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(chunk, pa.int64()), pa.array(body, pa.binary())], ["bucket", "chunk", "body"])

        for b in batches:
            data, offsets = string_buffer(b.column(2))
            doc, mark = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            for lo, n, h, counts, base in _parts(splitter, data, offsets):
                held.append((doc[lo : lo + n], mark[lo : lo + n], h, counts, base))
                size += len(h) + 16 * n
                if size >= CHUNK_WORDS:
                    yield flush()
        if held:
            yield flush()

    return tidied(run)


def _rows(rows) -> pa.RecordBatch:
    kind, bucket, body = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int64()), pa.array(body, pa.binary())], ["kind", "bucket", "body"])


_RUN = pa.schema([("run", pa.int32()), ("bucket", pa.int64()), ("body", pa.binary()), ("hits", pa.list_(pa.struct([("chunk", pa.int64()), ("body", pa.binary())])))])


def _run_row(run: int, bucket: int, body: bytes | None, hits: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([run], pa.int32()), pa.array([bucket]), pa.array([body], pa.binary()), pa.array([[{"chunk": c, "body": x} for c, x in hits]], _RUN.field(3).type)], schema=_RUN)


def _merge(run: int):
    """One bucket of a batch and of the runs: -> the next run's row, with the hits by chunk."""

    def merge(batch: pa.Table, runs: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return _RUN.empty_table()
        bucket, chunks, bodies = batch.column("bucket")[0].as_py(), batch.column("chunk").to_pylist(), batch.column("body").to_pylist()
        if bucket < 0:  # a chunk's documents: passed on
            return _run_row(run, bucket, None, list(zip(chunks, bodies, strict=True)))
        new = [_unpack_entries(x, NEW) for x in bodies]
        old = [_unpack_entries(x, OLD) for x in runs.column("body").to_pylist() if x is not None]
        h, many, doc, place = (_concat([*old, *(x[:4] for x in new)], k) for k in range(4))
        whole = _concat([[x[-1]] for x in (*old, *new)], 0)
        number = _concat(new, 4)
        chunk = np.repeat(np.array(chunks, np.int64), [len(x[0]) for x in new])
        n_old = len(h) - len(number)
        first = np.cumsum(many) - many
        # only windows of anchors that more than one entry has can be hits
        order = np.argsort(h, kind="stable")
        s = h[order]
        twice = np.zeros(len(s), bool)
        twice[1:] = s[1:] == s[:-1]
        twice[:-1] |= twice[1:]
        at = order[twice]
        entry = np.repeat(at, many[at])
        w = _order(first[at], many[at])
        where = place[entry] + w - first[entry]
        with np.errstate(over="ignore"):
            key = mix(h[entry].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + whole[w].view(np.uint64))
        o = np.lexsort((where, doc[entry], key))
        entry, w, key, where = entry[o], w[o], key[o], where[o]
        begin = np.ones(len(key), bool)
        begin[1:] = key[1:] != key[:-1]
        which = np.cumsum(begin) - 1
        rep = np.flatnonzero(begin)[which] if len(key) else which
        fresh = np.ones(len(h), bool)  # entries with a window that nothing before them has
        fresh[at] = False
        fresh[entry[begin]] = True
        keep = order[fresh[order] & (order >= n_old)]
        body = _pack_entries(h[keep], many[keep], doc[keep], place[keep], whole[_order(first[keep], many[keep])])
        hit = np.flatnonzero((entry >= n_old) & (doc[entry] > doc[entry[rep]])) if len(key) else which
        out = _run_row(run, bucket, body, list(_hits(chunk[entry[hit] - n_old], number[entry[hit] - n_old], where[hit], doc[entry[rep[hit]]], where[rep[hit]])))
        del h, many, doc, place, whole, entry, w, where, key, o, order, s
        tidy()
        return out

    return merge


def _hits(chunk, number, place, rep_doc, rep_place):
    """Single windows to (chunk, packed runs of neighbours)."""
    o = np.lexsort((place, number, chunk))
    chunk, number, place, rep_doc, rep_place = (x[o] for x in (chunk, number, place, rep_doc, rep_place))
    begin = _runs(chunk * np.int64(1 << 24) + number, place, rep_doc, rep_place)
    n = np.diff(begin, append=len(place))
    c = chunk[begin]
    for name in np.unique(c):
        at = begin[c == name]
        yield int(name), b"W" + _pack([(number[at], 3), (place[at], 5), (n[c == name], 5), (rep_doc[at], 8), (rep_place[at], 5)])


def _compact(table: pa.Table) -> pa.Table:
    """All runs of a bucket -> one."""
    runs = [_unpack_entries(x, OLD) for x in table.column("body").to_pylist()]
    h, many, doc, place, whole = (_concat(runs, k) for k in range(5))
    order, first = np.argsort(h, kind="stable"), np.cumsum(many) - many
    body = _pack_entries(h[order], many[order], doc[order], place[order], whole[_order(first[order], many[order])])
    return _run_row(max(table.column("run").to_pylist()), table.column("bucket")[0].as_py(), body, [])


_CLAIM = pa.schema([(x.split()[0], pa.int64()) for x in CLAIMS.split(", ")])


def _claims(table: pa.Table) -> pa.Table:
    """One chunk: its documents and hits -> claims: ``n`` windows from ``start`` on stand in rep_doc from rep_start on."""
    bodies = table.column("body").to_pylist()
    head = next(x for x in bodies if x[:1] == b"H")
    (doc, mark), at = _unpack(head, 1, (8, 8))
    (owner, place, many, to, to_place), _ = _unpack(head, at, (3, 5, 1, 3, 5))
    hits = [_unpack(x, 1, HIT)[0] for x in bodies if x[:1] == b"W"]
    number, start, n, rep_doc, rep_start = (_concat(hits, k) for k in range(5))
    flat = np.repeat(np.arange(len(number)), n)
    step = _order(np.zeros(len(n), np.int64), n)
    number, start, rep_doc, rep_start = number[flat], start[flat] + step, rep_doc[flat], rep_start[flat] + step
    if len(owner):  # the chunk's own repeats, window by window
        flat, step = np.repeat(np.arange(len(owner)), many), _order(np.zeros(len(many), np.int64), many)
        own, w, lead, lead_w = owner[flat], place[flat] + step, to[flat], to_place[flat] + step
        # of an older document of the chunk they are hits; in one of the same id they share its hits
        older = doc[lead] < doc[own]
        known = np.lexsort((start, number))
        span = np.int64(1 << 40)
        names = number[known] * span + start[known]
        asked = lead * span + lead_w
        found = np.minimum(np.searchsorted(names, asked), max(0, len(names) - 1))
        shared = ~older & (names[found] == asked) if len(names) else np.zeros(len(own), bool)
        via = known[found[shared]] if len(names) else found[:0]
        number, start = np.concatenate([number, own[older], own[shared]]), np.concatenate([start, w[older], w[shared]])
        rep_doc, rep_start = np.concatenate([rep_doc, doc[lead[older]], rep_doc[via]]), np.concatenate([rep_start, lead_w[older], rep_start[via]])
    o = np.lexsort((rep_start, rep_doc, start, number))
    number, start, rep_doc, rep_start = number[o], start[o], rep_doc[o], rep_start[o]
    one = np.ones(len(number), bool)
    one[1:] = (number[1:] != number[:-1]) | (start[1:] != start[:-1])
    number, start, rep_doc, rep_start = number[one], start[one], rep_doc[one], rep_start[one]
    begin = np.union1d(_runs(number, start, rep_doc, rep_start), np.flatnonzero(rep_start % CLAIM == 0)).astype(np.int64) if len(number) else np.empty(0, np.int64)
    n = np.diff(begin, append=len(number))
    return pa.table([pa.array(x) for x in (doc[number[begin]], mark[number[begin]], start[begin], n, rep_doc[begin], rep_start[begin])], schema=_CLAIM)


class FingerprintIndex:
    """Runs in a bucketed table in the shared folder.  ``add`` takes batches in the order of their ids.

    A folder holds the table ``1``, ``2``, ... after each compaction; ``open`` needs its path and number of buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, version: int = 1, runs: int = 0):
        self.spark, self.path, self.buckets, self.version, self.runs, self.last = spark, path, buckets, version, runs, 0
        self.table = self._declare()

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int, version: int) -> FingerprintIndex:
        index = cls(spark, path, buckets, version)
        row = spark.table(index.table).where("body is not null").agg(F.count_distinct("run"), F.max("run")).first()
        index.runs, index.last = row[0], row[1] or 0
        return index

    def _declare(self) -> str:
        name = f"fingerprints_{uuid.uuid4().hex[:12]}"
        n = min(self.buckets, TABLE_BUCKETS)
        self.spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (bucket) INTO {n} BUCKETS LOCATION '{self.path}/{self.version}'")
        return name

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("append").format("parquet").option("compression", "zstd").option("path", f"{self.path}/{self.version}").bucketBy(min(self.buckets, TABLE_BUCKETS), "bucket").saveAsTable(self.table)

    def add(self, docs: DataFrame) -> DataFrame:
        """``docs`` (doc, mark, text) -> its claims; the next run is written."""
        self.last += 1
        new = docs.mapInArrow(_cutter(self.buckets, Splitter(SPACES, fold=False)), CUT)
        held = self.spark.table(self.table).select("bucket", "body").where("body is not null")
        self._write(new.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(_merge(self.last), RUN))
        self.runs += 1
        hits = self.spark.table(self.table).where(F.col("run") == self.last).select(F.explode("hits").alias("hit")).select("hit.chunk", "hit.body")
        return hits.groupBy("chunk").applyInArrow(_claims, CLAIMS)

    def compact(self) -> None:
        """Merges all runs into one table of one run; the claims of batches before can't be read again."""
        old, path = self.table, f"{self.path}/{self.version}"
        held = self.spark.table(old).select("run", "bucket", "body").where("body is not null")
        self.version += 1
        self.table = self._declare()
        self._write(held.groupBy("bucket").applyInArrow(_compact, RUN))
        self.runs = 1
        self._forget(old, path)

    def _forget(self, table: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self) -> None:
        self._forget(self.table, self.path)


def _buckets(size: int) -> int:
    """Small buckets keep rows small; beyond ``FINE_BUCKETS`` of them a chunk's share of one would be too small."""
    return max(min(buckets_for(size, BUCKET_BYTES), FINE_BUCKETS), buckets_for(size, LARGE_BUCKET_BYTES))


def _marked(docs: DataFrame) -> DataFrame:
    """doc: the id to compare by; mark: a hash of the text, which tells rows of one id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("mark"), F.col("text"))


def _joined(b: np.ndarray, e: np.ndarray, data: np.ndarray) -> bytes:
    """The words at b:e joined by one space."""
    if not len(b):
        return b""
    size = e - b
    out = np.full(int(size.sum()) + len(b), 0x20, np.uint8)
    to = np.cumsum(size + 1) - (size + 1)
    out[np.repeat(to - (np.cumsum(size) - size), size) + np.arange(size.sum())] = data[np.repeat(b - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    return out[:-1].tobytes()


def _with_small(docs: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Joined by broadcast as long as ``small`` is, else by a shuffle."""
    size = small.agg(F.sum(F.lit(64) + F.coalesce(F.octet_length(small.columns[-1]), F.lit(0)).cast("long"))).first()[0] or 0
    return docs.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, keys, how)


def _digests(texts: pa.Array, asked: pa.Array):
    """asked: packed (start, words) per text -> packed 128-bit digests of those words."""
    splitter = Splitter(SPACES, fold=False)
    data, offsets = string_buffer(texts)
    for d, want in enumerate(asked.to_pylist()):
        at = np.frombuffer(want, "<i8").reshape(-1, 2)
        _, b, e, _ = splitter.words(data, offsets[d : d + 2])
        text = _joined(b, e, data)
        to = np.cumsum(e - b + 1) - (e - b + 1)
        ends = to + (e - b)
        yield b"".join(hashlib.blake2b(text[to[s] : ends[s + n - 1]] if s + n <= len(b) else b"\x00none", digest_size=16).digest() for s, n in at.tolist())


def _ask(table: pa.Table) -> pa.Table:
    """One (doc, mark): the passages asked of it, sorted and packed."""
    at = np.unique(np.stack([table.column("start").to_numpy(), table.column("words").to_numpy()], 1), axis=0).astype("<i8")
    return pa.table([table.column("doc").slice(0, 1), pa.array([at.tobytes()], pa.binary())], names=["doc", "asked"])


def verified(docs: DataFrame, claims: DataFrame, scratch: Scratch) -> DataFrame:
    """The claims (doc, mark, start, n) whose words are the same in both documents, and those settled by their words."""
    words = F.col("n") + WINDOW - 1
    wanted = claims.select("doc", "start", words.alias("words")).unionByName(claims.select(F.col("rep_doc").alias("doc"), F.col("rep_start").alias("start"), words.alias("words"))).distinct()
    asked = scratch.save(wanted.groupBy("doc").applyInArrow(_ask, "doc long, asked binary"))
    slices = "doc long, mark long, start long, words long, digest binary"

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                doc, mark, ask = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(3)
                raw = ask.to_pylist()
                at = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in raw])
                count = [len(x) // 16 for x in raw]
                digest = b"".join(_digests(part.column(2), ask))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(doc, count)), pa.array(np.repeat(mark, count)), pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array([digest[k : k + 16] for k in range(0, len(digest), 16)], pa.binary())], names=["doc", "mark", "start", "words", "digest"])

    found = docs.join(asked, "doc").select("doc", "mark", "text", "asked").mapInArrow(tidied(run), slices)
    found = scratch.save(found)
    own = found.select("doc", "mark", "start", F.col("words").alias("own_words"), F.col("digest").alias("own"))
    with_own = claims.withColumn("own_words", words).join(own, ["doc", "mark", "start", "own_words"])
    # how often a passage is claimed doesn't matter: each different claim is held once against the older document
    pairs = with_own.select("rep_doc", "rep_start", "own_words", "own").distinct()
    there = found.select(F.col("doc").alias("rep_doc"), F.col("start").alias("rep_start"), F.col("words").alias("own_words"), F.col("digest").alias("own")).distinct()
    bad = scratch.save(pairs.join(there, ["rep_doc", "rep_start", "own_words", "own"], "left_anti"))
    good = claims.select("doc", "mark", "start", "n")
    if bad.isEmpty():
        return good
    keys = ["rep_doc", "rep_start", "own_words", "own"]
    held = scratch.save(with_own.join(bad.withColumn("bad", F.lit(True)), keys, "left"))
    return held.where("bad is null").select("doc", "mark", "start", "n").unionByName(_settled(docs, held.where("bad").select("doc", "mark", "start", "n"), scratch))


def _window_texts(with_starts: bool, hashes: np.ndarray | None):
    """(doc, mark, text[, packed (start, words)]) -> (doc, mark, start, win): windows asked for, or all of a known hash."""

    def run(batches):
        splitter = Splitter(SPACES, fold=False)
        for b in batches:
            data, offsets = string_buffer(b.column(2))
            doc, mark = b.column(0).to_numpy(), b.column(1).to_numpy()
            asked = b.column(3).to_pylist() if with_starts else None
            for d in range(b.num_rows):
                h, s, e, first = splitter.words(data, offsets[d : d + 2])
                whole, pos = windows(h, first, WINDOW)
                if asked:
                    at = np.frombuffer(asked[d], "<i8").reshape(-1, 2)
                    pos = np.unique(_order(at[:, 0], at[:, 1] - WINDOW + 1))
                elif hashes is not None:
                    pos = pos[np.isin(whole, hashes)]
                for lo in range(0, len(pos), 4096):
                    p = pos[lo : lo + 4096]
                    win = [_joined(s[i : i + WINDOW], e[i : i + WINDOW], data) for i in p.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), doc[d])), pa.array(np.full(len(p), mark[d])), pa.array(p), pa.array(win, pa.binary())], names=["doc", "mark", "start", "win"])

    return run


def _settled(docs: DataFrame, claims: DataFrame, scratch: Scratch) -> DataFrame:
    """Claims that failed, window by window against every document by the words themselves."""
    schema = "doc long, mark long, start long, win binary"
    wanted = claims.select("doc", "start", (F.col("n") + WINDOW - 1).alias("words")).groupBy("doc").applyInArrow(_ask, "doc long, asked binary")
    doubted = docs.join(wanted, "doc").select("doc", "mark", "text", "asked").mapInArrow(_window_texts(True, None), schema)
    doubted = scratch.save(doubted.join(claims.select("doc", "mark").distinct(), ["doc", "mark"], "left_semi"))
    wins = doubted.select("win").distinct()

    def hashed(batches):
        splitter = Splitter(SPACES, fold=False)
        for b in batches:
            data, offsets = string_buffer(b.column(0))
            h, _, _, first = splitter.words(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(windows(h, first, WINDOW)[0].view(np.int64))], names=["h"])

    known = None
    if wins.count() <= KNOWN_HASHES:
        known = np.unique(wins.mapInArrow(hashed, "h long").toArrow().column("h").to_numpy().view(np.uint64))
    every = docs.select("doc", "mark", "text").mapInArrow(_window_texts(False, known), schema)
    least = every.join(wins, "win", "left_semi").groupBy("win").agg(F.min("doc").alias("least"))
    return doubted.join(least, "win").where("doc > least").select("doc", "mark", "start", F.lit(1).cast("long").alias("n"))


_SPANS = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("spans", pa.binary())])


def _spans(table: pa.Table) -> pa.Table:
    """One (doc, mark): its removed words as packed (first, behind the last), disjoint and sorted."""
    start, n = table.column("start").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(start, kind="stable")
    a, b = start[order], np.maximum.accumulate((start + n + WINDOW - 1)[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    at = np.flatnonzero(new)
    ends = np.append(b[at[1:] - 1], b[-1:])
    body = np.stack([a[at], ends], 1).astype("<i8").tobytes()
    return pa.table([table.column("doc").slice(0, 1), table.column("mark").slice(0, 1), pa.array([body], pa.binary())], schema=_SPANS)


def duplicate_spans(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc, mark, spans (packed int64 pairs) for each document that loses words."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    index = FingerprintIndex(spark, scratch.path(), _buckets(text_bytes(docs)))
    keyed = _marked(docs)
    cuts = [k / batches for k in range(1, batches)]
    bounds = keyed.agg(F.percentile_approx("doc", F.array(*map(F.lit, cuts)), 10_000)).first()[0] if cuts else []
    bounds = sorted(set(bounds or []))
    claims = None
    for k in range(len(bounds) + 1):
        part = keyed
        if k:
            part = part.where(F.col("doc") > bounds[k - 1])
        if k < len(bounds):
            part = part.where(F.col("doc") <= bounds[k])
        one = scratch.save(index.add(part))
        claims = one if claims is None else claims.unionByName(one)
        if index.runs >= FAN_IN and k < len(bounds):
            index.compact()
    index.drop()
    spans = scratch.save(verified(keyed, claims, scratch).groupBy("doc", "mark").applyInArrow(_spans, "doc long, mark long, spans binary"))
    scratch.keep(spans)
    return spans


def _with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with one more last column: the packed spans; rows of one id and text share them."""
    own = docs.columns
    doc, mark, spans = (f"__dedup_{k}_{uuid.uuid4().hex[:8]}" for k in ("doc", "mark", "spans"))
    found = duplicate_spans(docs).toDF(doc, mark, spans)
    keyed = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(mark, F.xxhash64("text"))
    return _with_small(keyed, found, [doc, mark], "left").select(*(F.col(f"`{c}`") for c in own), F.col(spans))


def _kept(texts: pa.Array, spans: pa.Array):
    """Per text: (words, removed, begin and end of the kept words, bytes)."""
    splitter = Splitter(SPACES, fold=False)
    data, offsets = string_buffer(texts)
    cut, lo = spans.to_pylist(), 0
    while lo < len(texts):
        hi = min(len(texts), lo + 256, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1))
        _, begin, end, first = splitter.words(data, offsets[lo : hi + 1])
        for d in range(hi - lo):
            b, e = begin[first[d] : first[d + 1]], end[first[d] : first[d + 1]]
            n = len(b)
            if cut[lo + d]:
                at = np.frombuffer(cut[lo + d], "<i8").reshape(-1, 2)
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, at[:, 0], 1)
                np.add.at(edge, np.minimum(at[:, 1], n), -1)
                stay = np.cumsum(edge)[:n] == 0
                b, e = b[stay], e[stay]
            yield n, n - len(b), b, e, data
        lo = hi


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""

    def run(batches):
        for b in batches:
            rows = [(n, gone, hashlib.sha256(_joined(s, e, data)).hexdigest()) for n, gone, s, e, data in _kept(b.column(1), b.column(2))]
            n, gone, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return joined.mapInArrow(tidied(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with duplicate words taken out of ``text`` (a text that loses none stays as written)."""
    own = docs.columns
    at = own.index("text")

    def run(batches):
        for b in (x.slice(lo, 512) for x in batches for lo in range(0, x.num_rows, 512)):
            texts = b.column(at)
            lost = np.zeros(b.num_rows, bool)
            new = []
            for d, (_, gone, s, e, data) in enumerate(_kept(texts, b.column(b.num_columns - 1))):
                lost[d] = gone > 0
                if gone:
                    new.append(_joined(s, e, data).decode())
            # of two columns, the text as written and the new ones
            take = np.where(lost, b.num_rows + np.cumsum(lost) - 1, np.arange(b.num_rows))
            text = pa.concat_arrays([texts, pa.array(new, pa.string())]).take(pa.array(take))
            yield pa.RecordBatch.from_arrays([text if k == at else b.column(k) for k in range(len(own))], names=own)

    return _with_spans(docs).mapInArrow(tidied(run), docs.schema)
