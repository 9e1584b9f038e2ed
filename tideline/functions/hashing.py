"""Hash routing: key -> fraction of the key space -> segment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The 64-bit constants of murmur3_128 (x64) and its finaliser; 31-polynomial hashes of seed names.
C1, C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
F1, F2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
ROUTER = "EventRouter"
TABLE_ROUTER = "KeyValueTableRouter"
CONTAINER_MAPPER = "SegmentToContainerMapper"
MASK52 = (1 << 52) - 1
M64 = (1 << 64) - 1


def string_seed(name: str) -> int:
    """The 32-bit 31-polynomial of a name, signed."""
    h = 0
    for unit in name.encode("utf-16-le")[::2] if name.isascii() else np.frombuffer(name.encode("utf-16-le"), "<u2").tolist():
        h = (31 * h + unit) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & M64


def _final(k: int) -> int:
    k ^= k >> 33
    k = k * F1 & M64
    k ^= k >> 33
    k = k * F2 & M64
    return k ^ (k >> 33)


def murmur3_128(data: bytes, seed: int) -> tuple[int, int]:
    h1 = h2 = seed & 0xFFFFFFFF
    whole = len(data) & ~15
    for i in range(0, whole, 16):
        k1, k2 = int.from_bytes(data[i : i + 8], "little"), int.from_bytes(data[i + 8 : i + 16], "little")
        h1 ^= _rotl(k1 * C1 & M64, 31) * C2 & M64
        h1 = ((_rotl(h1, 27) + h2) * 5 + 0x52DCE729) & M64
        h2 ^= _rotl(k2 * C2 & M64, 33) * C1 & M64
        h2 = ((_rotl(h2, 31) + h1) * 5 + 0x38495AB5) & M64
    tail = data[whole:]
    k1, k2 = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:], "little")
    if k2:
        h2 ^= _rotl(k2 * C2 & M64, 33) * C1 & M64
    if k1:
        h1 ^= _rotl(k1 * C1 & M64, 31) * C2 & M64
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & M64
    h2 = (h2 + h1) & M64
    h1, h2 = _final(h1), _final(h2)
    h1 = (h1 + h2) & M64
    return h1, (h2 + h1) & M64


def to_fraction(h: int) -> float:
    return ((h >> 12) & MASK52) / float(1 << 52)


def _fractions(keys: pd.Series, seed: int, encode) -> pd.Series:
    known = {k: to_fraction(murmur3_128(encode(k), seed)[0]) for k in keys.dropna().unique()}
    return keys.map(known)


def exact_fraction(key: Column | str) -> Column:
    """The router's fraction of a string key (Arrow batches; each distinct key of a batch is hashed once)."""
    seed = string_seed(ROUTER)

    @F.pandas_udf("double")
    def fraction(keys: pd.Series) -> pd.Series:
        return _fractions(keys, seed, lambda k: k.encode("utf-16-le"))

    return fraction(key)


def exact_table_fraction(key: Column | str) -> Column:
    """The fraction of a binary primary key of a key-value table."""
    seed = string_seed(TABLE_ROUTER)

    @F.pandas_udf("double")
    def fraction(keys: pd.Series) -> pd.Series:
        return _fractions(keys.map(bytes, na_action="ignore"), seed, lambda k: k)

    return fraction(key)


def consistent_bucket(h: int, buckets: int) -> int:
    """Jump consistent hash: going from n to n + 1 buckets moves only into the new one."""
    state, at = h & M64, 0
    while True:
        state = (2862933555777941757 * state + 1) & M64
        nxt = int((at + 1) / ((((state >> 33) & 0x7FFFFFFF) + 1) / float(1 << 31)))
        if not 0 <= nxt < buckets:
            return at
        at = nxt


def hash_to_bucket(key: Column | str, buckets: int, name: str = CONTAINER_MAPPER) -> Column:
    seed = string_seed(name)

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        known = {k: consistent_bucket(murmur3_128(k.encode("utf-16-le"), seed)[0], buckets) for k in keys.dropna().unique()}
        return keys.map(known).astype("Int32")

    return bucket(key)


def fraction(key: Column | str) -> Column:
    """A fraction in [0, 1) from md5: all in the JVM, and the same in any SQL engine."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def to_uuid(key: Column | str) -> Column:
    h = F.md5(F.col(key).cast("binary") if isinstance(key, str) else key.cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def route(events: DataFrame, epochs: DataFrame, frac: str = "frac") -> DataFrame:
    """Adds segment_id: ranges are (low, high], and 0.0 is in the first.  An equi-join on epoch, so the
    ranges are a residual; the epoch table is metadata and small enough for Spark to broadcast it."""
    ep = epochs.select(F.col("epoch").alias("__e"), "segment_id", "key_start", "key_end")
    in_range = (F.col(frac) <= F.col("key_end")) & ((F.col(frac) > F.col("key_start")) | (F.col("key_start") == 0.0))
    return events.join(ep, (F.col("epoch") == F.col("__e")) & in_range).drop("__e", "key_start", "key_end")


def key_fraction(key: str, event_id: str) -> Column:
    """The fraction of a key; an event without one gets a place at random, but the same one in every attempt."""
    spread = F.pmod(F.xxhash64(event_id), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
    return F.coalesce(fraction(F.col(key).cast("string")), spread)
