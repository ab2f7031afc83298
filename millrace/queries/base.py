"""A family of queries: each a function of (spark, folder), with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.context import Engine
from millrace.frame import Frame, OrderedFrame


class Family:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def register(f: Callable[[Tables], Frame]) -> Callable:
            self.queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir)).df
            if sql:
                self.sql[f.__name__] = sql
            return f

        return register


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.engine, self.spark, self.folder = Engine(spark), spark, sf_dir

    def __getattr__(self, name: str) -> Frame:
        return self.engine.read_parquet(f"{self.folder}/{name}.parquet")

    def events_of(self, *kinds: str) -> OrderedFrame:
        """Events of some types, ordered by their time."""
        return self.events.filter_sql(f"event_type in ({', '.join(repr(k) for k in kinds)})").ordered_by("ts")
