"""Names of segments and of the internal streams and tables that belong to a stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The markers in qualified names.
EPOCH_MARK, TXN_MARK, TRANSIENT_MARK = ".#epoch.", "#transaction.", "#transient."
MARK_STREAM, READER_GROUP, TABLE = "_MARK", "_RG", "_kvtable"
ATTRIBUTES, INDEX = "$attributes.index", "#index"


def scoped(scope: Column, stream: Column) -> Column:
    return F.concat_ws("/", scope, stream)


def segment_name(scope: Column, stream: Column, segment_id: Column) -> Column:
    number = segment_id.bitwiseAND(F.lit(0xFFFFFFFF)).cast("string")
    return F.concat(scoped(scope, stream), F.lit("/"), number, F.lit(EPOCH_MARK), F.shiftright(segment_id, 32).cast("string"))


def segment_of(name: Column) -> Column:
    """The id in a qualified segment name; null if it isn't one."""
    number, epoch = (F.regexp_extract(name, r"/(\d+)\.#epoch\.(\d+)", k).try_cast("long") for k in (1, 2))
    return F.shiftleft(epoch, 32).bitwiseOR(number)


def scope_of(name: Column) -> Column:
    return F.when(name.contains("/"), F.substring_index(name, "/", 1))


def stream_of(name: Column) -> Column:
    parts = F.split(name, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, 2))


def transaction_name(segment: Column, txn_id: Column) -> Column:
    return F.concat(segment, F.lit(TXN_MARK), F.replace(txn_id, F.lit("-"), F.lit("")))


def parent_of(name: Column) -> Column:
    """The segment that a transaction or transient segment will be merged into."""
    return F.regexp_extract(name, r"^(.*?)#(?:transaction|transient)\.", 1)


def is_transaction(name: Column) -> Column:
    return name.contains(TXN_MARK)


def mark_stream(stream: Column) -> Column:
    return F.concat(F.lit(MARK_STREAM), stream)


def reader_group_stream(group: Column) -> Column:
    return F.concat(F.lit(READER_GROUP), group)


def attributes_name(segment: Column) -> Column:
    return F.concat(segment, F.lit(ATTRIBUTES))


def is_internal(stream: Column) -> Column:
    return stream.startswith("_")
