"""Codecs: how values become the bytes of events, and how they are read back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Codec:
    """Two column functions: from a value to binary, and from binary to the value.  A null stays null."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


#: Text as UTF-8.
TEXT = Codec(lambda c: F.encode(c, "utf-8"), lambda c: F.decode(c, "utf-8"))


def json(schema: str) -> Codec:
    """Structs, arrays or maps as JSON; bytes that aren't such JSON become null fields."""
    return Codec(lambda c: F.encode(F.to_json(c), "utf-8"), lambda c: F.from_json(F.decode(c, "utf-8"), schema))


def custom(encode: Callable[[object], bytes], decode: Callable[[bytes], object], kind: str) -> Codec:
    """A codec written in Python for values of the type ``kind``, run over Arrow batches."""

    @F.pandas_udf("binary")
    def to_bytes(values: pd.Series) -> pd.Series:
        return values.map(encode, na_action="ignore")

    @F.pandas_udf(kind)
    def from_bytes(values: pd.Series) -> pd.Series:
        return values.map(lambda b: decode(bytes(b)), na_action="ignore")

    return Codec(to_bytes, from_bytes)
