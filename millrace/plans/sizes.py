"""Broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of a side that is broadcast, by its rows and the width of its columns.
MOST_BYTES = 64_000_000


def _width(t: T.DataType) -> int:
    """Bytes of a value in memory; strings and arrays by a generous guess."""
    if isinstance(t, T.StructType):
        return sum(_width(f.dataType) for f in t.fields) + 8
    if isinstance(t, T.ArrayType):
        return 32 * _width(t.elementType)
    if isinstance(t, T.MapType):
        return 32 * (_width(t.keyType) + _width(t.valueType))
    return 40 if isinstance(t, (T.StringType, T.BinaryType)) else 16 if isinstance(t, T.DecimalType) else 8


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast if ``df`` has at most ``max_rows`` rows and ``MOST_BYTES``, counted, else leave the choice to the planner.

    Counting stops at the limit, so a large side costs no full pass; give a side that is cheap
    to read twice (a durable cut).
    """
    most = max(1, min(max_rows, MOST_BYTES // (_width(df.schema) + 16)))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
