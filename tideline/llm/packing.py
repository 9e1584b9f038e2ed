"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities.

A document's ids, closed by ``END``, are cut into pieces of ``LENGTH`` and a rest.  Documents are dealt into
groups at random (by hash), the number of groups following the number of rows; each group is packed
on its own: longest piece first, each into the first bin with room, which a tree of the bins' free
room finds in logarithmic time.

Tokenising goes by distinct piece: a tokenizer of known structure never looks across white space, nor from letters to punctuation, so each
distinct piece of a block is encoded once, kept in a bounded cache, and texts are put together from pieces by numpy.  A tokenizer of any other
structure encodes whole texts.  A piece is known by its 64-bit hash and length.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed as rows of their own;
a null doc_id stays null; an empty table gives no rows; ties in length go by id, start and checksum; other columns aren't read.
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.textkernel import SPACES, Splitter, string_buffer, tidied

LENGTH, END = 4096, 2
GROUP_ROWS = 8192
CACHE_WORDS = 500_000
BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20
TEXT_WORDS = 500
#: Stands between words that are encoded together; a control character, so hardly ever part of one.
MARK = "\x01"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The structure of the tokenizers whose texts may be put together from pieces.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def goes_by_pieces(tokenizer) -> bool:
    """Whether a text's ids are those of its pieces: the tokenizer drops white space, lower-cases character by character, and
    splits runs of letters, single digits and runs of other characters before anything else."""
    spec = json.loads(tokenizer.to_str())
    normal, before, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    steps = before.get("pretokenizers") or [{}]
    split = steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
    rest = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in steps[1:])
    marked = all(x["content"].startswith("<|") and not x["normalized"] for x in spec.get("added_tokens") or [])
    one = len(tokenizer.encode(MARK, add_special_tokens=False).ids) == 1
    return bool(normal.get("normalizers") == NORMAL and split and rest and marked and one and model.get("type") == "BPE" and not model.get("dropout"))


def _kinds() -> np.ndarray:
    """Letters 1, other characters 2, digits 3; an apostrophe and bytes beyond ASCII, which may belong to their neighbours, 0."""
    kinds = np.full(256, 2, np.uint8)
    kinds[128:] = 0
    kinds[39] = 0
    kinds[[*range(65, 91), *range(97, 123)]] = 1
    kinds[48:58] = 3
    kinds[[*SPACES]] = 0
    return kinds


class WordEncoder:
    """ids of texts.  With a tokenizer that allows it (``goes_by_pieces``) each distinct piece of a block is encoded once and kept
    in a bounded cache; other tokenizers, and texts in which a special token's string may stand, encode whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_pieces = goes_by_pieces(self.tokenizer)
        self.splitter = Splitter(SPACES, fold=True, kinds=_kinds())
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _encode_words(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one behind the other, how many each has).

        They are encoded in texts of ``TEXT_WORDS`` with a mark of one known id after each, and told apart by it."""
        gap = f" {MARK} ".encode()
        size = e - s
        to = np.cumsum(size + len(gap)) - (size + len(gap))
        text = np.empty(int(size.sum()) + len(gap) * len(s), np.uint8)
        at = (to + size)[:, None] + np.arange(len(gap))
        text[at] = np.frombuffer(gap, np.uint8)
        before = np.cumsum(size) - size
        text[np.repeat(to - before, size) + np.arange(int(size.sum()))] = data[np.repeat(s - before, size) + np.arange(int(size.sum()))]
        raw, ends = text.tobytes(), [*to[::TEXT_WORDS].tolist(), len(text)]
        parts = [raw[a:b].decode() for a, b in zip(ends, ends[1:], strict=False)]
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.mark[0])
        if len(ends) != len(s):  # a word that has the mark itself: one by one
            each = [self.tokenizer.encode(bytes(data[a:b]).decode(), add_special_tokens=False).ids for a, b in zip(s.tolist(), e.tolist(), strict=True)]
            return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        each = [[*self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, END] for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
        begin = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        return np.fromiter((i for x in each for i in x), np.uint32, int(begin[-1])), begin

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``END`` behind it; where each text's begin)."""
        if not self.by_pieces or b"<|" in data.tobytes():
            return self._whole(data, offsets)
        h, s, e, first = self.splitter.words(data, offsets)
        unique, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.slot) > CACHE_WORDS:
            self._clear()
        names = unique.tolist()
        slot = np.fromiter(map(self.slot.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(slot < 0)
        if len(new):
            ids, sizes = self._encode_words(data, s[at[new]], e[at[new]])
            base = len(self.start)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.flat = np.concatenate([self.flat, ids])
            slot[new] = base + np.arange(len(new))
            self.slot.update(zip(unique[new].tolist(), slot[new].tolist(), strict=True))
        slot = slot[inverse]
        size = self.size[slot]
        before = np.concatenate([[0], np.cumsum(size)])
        begin = before[first] + np.arange(len(first))
        out = np.full(int(begin[-1]), END, np.uint32)
        to = np.repeat(np.arange(len(first) - 1), np.diff(first))  # each word's text: so many END stand before it
        out[np.arange(before[-1]) + np.repeat(to, size)] = self.flat[np.repeat(self.start[slot] - before[:-1], size) + np.arange(before[-1])]
        return out, begin


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids): each document cut at multiples of ``length``."""
    path = path or tokenizer_path()

    def run(batches):
        encoder = WordEncoder(path)
        for b in batches:
            data, offsets = string_buffer(b.column(1))
            ids = b.column(0)
            hi = 0
            while (lo := hi) < len(ids):
                hi = min(len(ids), lo + BLOCK_DOCS, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1))
                base = offsets[lo]
                tokens, begin = encoder.encode(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
                raw, n = tokens.astype("<u4").tobytes(), np.diff(begin)
                count = -(-n // length)
                own = np.repeat(np.arange(hi - lo), count)
                start = (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)) * length
                size = np.minimum(length, n[own] - start)
                at = begin[own] + start
                crc = [zlib.crc32(raw[4 * x : 4 * (x + m)]) for x, m in zip(at.tolist(), size.tolist(), strict=True)]
                columns = [ids.slice(lo, hi - lo).take(pa.array(own)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[own])]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, begin[-1]), pa.int32()), pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(tidied(run), PIECES + (", ids array<int>" if with_ids else ""))


class Bins:
    """First-fit over a tournament tree: an inner node has the most room of any bin below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, room left before): the first bin with room for ``size``."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        room, found = tree[at], at - self.leaves
        tree[at] = room - size
        while at > 1:
            at //= 2
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
        return found, room


def first_fit_decreasing(sizes: list[int], length: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; sizes are in falling order."""
    bins, out = Bins(max(1, len(sizes)), length), []
    for size in sizes:
        number, room = bins.place(size)
        out.append((number, length - room))
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """``pieces`` with sequence_id and offset (gapless from 0 in each sequence)."""
    groups = max(1, -(-docs.count() // GROUP_ROWS))
    cut = pieces(docs, path, length, with_ids)
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit(5)), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        table = table.drop_columns(["group"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        number, offset = zip(*first_fit_decreasing(table.column("length").to_pylist(), length), strict=True)
        table = table.append_column("sequence_id", pa.array(np.array(number, np.int64) + (group << 32)))
        return table.append_column("offset", pa.array(np.array(offset, np.int64)))

    return dealt.groupBy("group").applyInArrow(run, ", ".join([PIECES, *(["ids array<int>"] * with_ids), "sequence_id long, offset long"]))
