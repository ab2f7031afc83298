"""Streaming operators: they take and give streaming DataFrames.

Late data is bounded by a watermark on the time column; rows older than it are dropped by
the operators that keep state.  In a batch the same functions give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _aggregates(spec: Mapping[str, str]) -> list:
    return [F.expr(sql).alias(name) for name, sql in spec.items()]


def windowed(stream: DataFrame, *, time: str, by: str, size: str, aggregates: Mapping[str, str], delay: str, hop: str | None = None) -> DataFrame:
    """Tumbling or hopping windows: ``time`` (the start), ``by`` and the aggregates."""
    w = F.window(time, size, hop) if hop else F.window(time, size)
    done = stream.withWatermark(time, delay).groupBy(w.alias("w"), by).agg(*_aggregates(aggregates))
    return done.select(F.col("w.start").alias(time), by, *aggregates)


def sessions(stream: DataFrame, *, time: str, by: str, timeout: str, aggregates: Mapping[str, str], delay: str) -> DataFrame:
    done = stream.withWatermark(time, delay).groupBy(F.session_window(time, timeout).alias("w"), by).agg(*_aggregates(aggregates))
    return done.select(F.col("w.start").alias(time), by, *aggregates)


def interval_join(left: DataFrame, right: DataFrame, *, time: str, by: str, before: str, delay: str, names: tuple[str, str]) -> DataFrame:
    """Pairs of one key whose right time lies in the ``before`` up to the left time; ids are renamed to ``names``."""
    l = left.withWatermark(time, delay).select(F.col(by).alias("lk"), F.col(time).alias("lt"), F.col("id").alias(names[0]))
    r = right.withWatermark(time, delay).select(F.col(by).alias("rk"), F.col(time).alias("rt"), F.col("id").alias(names[1]))
    return l.join(r, F.expr(f"lk = rk and rt >= lt - interval {before} and rt <= lt")).select(*names)


def distinct(stream: DataFrame, keys: list[str], *, time: str | None = None, delay: str | None = None) -> DataFrame:
    """First rows of each key; with a watermark a key is forgotten after ``delay``, so state stays bounded."""
    if time and delay:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys).select(*keys)
    return stream.select(*keys).dropDuplicates(keys)


def running_maximum(stream: DataFrame, *, by: str, value: str) -> DataFrame:
    """``by``, ``n`` and ``top`` after every batch in which a key has rows, kept as state in Python."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, top = state.get if state.exists else (0, float("-inf"))
        for b in batches:
            n, top = n + len(b), max(top, b[value].max())
        state.update((n, top))
        yield pd.DataFrame({by: [key[0]], "n": [n], "top": [top]})

    kind = stream.schema[by].dataType.simpleString()
    return stream.groupBy(by).applyInPandasWithState(update, f"{by} {kind}, n long, top double", "n long, top double", "update", "NoTimeout")
