"""User-defined operators in Python: batch maps, stateful executors, co-groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Executor:
    """A stateful operator.  A new copy serves each partition (or key); it sees its batches in order.

    ``execute`` gets a batch and may return a frame; ``done`` may return the rest.
    """

    def execute(self, batch: pd.DataFrame, stream: int) -> pd.DataFrame | None:
        return None

    def done(self) -> pd.DataFrame | None:
        return None


def map_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, columns: list[str] | None = None) -> DataFrame:
    """``f`` on every Arrow batch; it may return any number of rows.  Only ``columns`` are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield f(b)

    return (df.select(*columns) if columns else df).mapInPandas(run, schema)


def run_executor(
    df: DataFrame, make: Callable[[], Executor], schema: str, *, columns: list[str] | None = None, by: str | None = None, order_by: list[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """A stateful operator over partitions.

    With ``by`` all rows of a key go to one copy; with ``order_by`` a copy sees its rows in
    that order within the key.  ``partitions`` fixes their number (1 for a global state).
    """
    narrow = df.select(*columns) if columns else df
    if by:
        narrow = narrow.repartition(partitions, by) if partitions else narrow.repartition(by)
    elif partitions:
        narrow = narrow.coalesce(partitions)
    if order_by:
        narrow = narrow.sortWithinPartitions(*([by] if by else []), *order_by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        executor = make()
        for b in batches:
            out = executor.execute(b, 0)
            if out is not None:
                yield out
        out = executor.done()
        if out is not None:
            yield out

    return narrow.mapInPandas(run, schema)


def run_per_key(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, by: list[str], columns: list[str] | None = None) -> DataFrame:
    """``f`` on all rows of one key; a key must fit a task."""
    narrow = df.select(*columns) if columns else df
    return narrow.groupBy(*by).applyInPandas(lambda pdf: f(pdf), schema)


def cogroup(left: DataFrame, right: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, *, by: str, left_columns: list[str] | None = None, right_columns: list[str] | None = None) -> DataFrame:
    """``f`` on the rows of one key of both sides."""
    l = left.select(*left_columns) if left_columns else left
    r = right.select(*right_columns) if right_columns else right
    return l.groupBy(by).cogroup(r.groupBy(by)).applyInPandas(lambda a, b: f(a, b), schema)


def mingle(sources: list[DataFrame], make: Callable[[], Executor], schema: str) -> DataFrame:
    """One stateful operator over several sources without a shuffle; ``stream`` tells them apart.

    A column that a source lacks is null; batches of different sources aren't mixed.
    """
    tagged = [s.withColumn("__stream", F.lit(k)) for k, s in enumerate(sources)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    own = {k: s.columns for k, s in enumerate(sources)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        executor = make()
        for b in batches:
            for k, part in b.groupby("__stream", sort=True):
                out = executor.execute(part[own[k]].reset_index(drop=True), int(k))
                if out is not None:
                    yield out
        out = executor.done()
        if out is not None:
            yield out

    return both.mapInPandas(run, schema)
