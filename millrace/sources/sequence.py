"""A user-defined source: numbers in sequence, split over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _Span(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class SequenceReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.n, self.parts = int(options.get("n", 0)), max(1, int(options.get("parts", 4)))

    def partitions(self) -> list[_Span]:
        return [_Span(self.n * k // self.parts, self.n * (k + 1) // self.parts) for k in range(self.parts)]

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        for at in range(partition.start, partition.stop, 65_536):
            yield pa.record_batch([pa.array(range(at, min(partition.stop, at + 65_536)), pa.int64())], names=["value"])


class SequenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_sequence"

    def schema(self) -> str:
        return "value long"

    def reader(self, schema: StructType) -> SequenceReader:
        return SequenceReader(self.options)


def read_sequence(spark: SparkSession, n: int, parts: int = 4) -> DataFrame:
    spark.dataSource.register(SequenceSource)
    return spark.read.format("millrace_sequence").option("n", n).option("parts", parts).load()
