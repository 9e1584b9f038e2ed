"""Ordered folds: sequential logic per key, for updates whose outcome depends on all before them.

Rows are dealt by key and sorted; the worker streams through them holding one state, so a key of any
size needs no more memory than its state."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(df: DataFrame, keys: list[str], order: list[str], init: Callable[[], object], step: Callable[[object, dict], tuple[object, dict | None]], schema: str) -> DataFrame:
    """step(state, row) -> (state, output row or None), over each key's rows in order."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        key, state = None, None
        for b in batches:
            rows = []
            for row in b.to_pylist():
                k = tuple(row[c] for c in keys)
                if k != key:
                    key, state = k, init()
                state, made = step(state, row)
                if made is not None:
                    rows.append(made)
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
