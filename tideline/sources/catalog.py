"""Scopes, streams and their settings as a table of metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A stream has fewer tags than this, each shorter than MAX_TAG.
MAX_TAGS, MAX_TAG = 128, 256
#: Allowed changes of a stream's state, besides staying in it.
STATES = {
    "UNKNOWN": ("CREATING",), "CREATING": ("ACTIVE",), "ACTIVE": ("SCALING", "TRUNCATING", "COMMITTING_TXN", "UPDATING", "SEALING"),
    "SCALING": ("ACTIVE",), "TRUNCATING": ("ACTIVE",), "COMMITTING_TXN": ("ACTIVE",), "UPDATING": ("ACTIVE",), "SEALING": ("SEALED",), "SEALED": (),
}

#: Bits of a segment's type; a fixed-key table is a table, a system segment is internal.
FLAGS = {"table": 0b00000001, "fixed_key_table": 0b00000101, "internal": 0b00010000, "system": 0b00110000, "critical": 0b01000000, "transient": 0b10000000}


def with_flags(segments: DataFrame, column: str) -> DataFrame:
    """Adds a boolean for each flag in a segment's type bits."""
    return segments.withColumns({name: F.col(column).bitwiseAND(F.lit(bits)) == bits for name, bits in FLAGS.items()})


def tagged(streams: DataFrame) -> DataFrame:
    """Streams whose tags are allowed."""
    return streams.where((F.size("tags") < MAX_TAGS) & F.forall("tags", lambda t: F.length(t) < MAX_TAG))


def by_tag(streams: DataFrame, tag: str) -> DataFrame:
    return streams.where(F.array_contains("tags", tag))


def page(names: DataFrame, column: str, token: str | None, n: int) -> DataFrame:
    """The next ``n`` names after a token."""
    out = names if token is None else names.where(F.col(column) > token)
    return out.orderBy(column).limit(n)


def illegal_moves(changes: DataFrame) -> DataFrame:
    """Rows (stream, was, becomes) that the state machine doesn't allow."""
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, to in STATES.items() for b in (a, *to)))
    return changes.where(~F.array_contains(allowed, F.concat_ws(">", "was", "becomes")))


def known(asked: DataFrame, scopes: DataFrame, streams: DataFrame, active: DataFrame) -> DataFrame:
    """asked (scope, stream, segment_id) with scope_exists, stream_exists and segment_valid (the segment is one of the active ones)."""
    out = asked
    for name, keys, table in (("scope_exists", ["scope"], scopes), ("stream_exists", ["scope", "stream"], streams), ("segment_valid", ["scope", "stream", "segment_id"], active)):
        there = table.select(*keys).distinct().withColumn(name, F.lit(True))
        out = out.join(there, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out
