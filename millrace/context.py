"""Entry point of the frame API: sources, settings and SQL."""

from __future__ import annotations

import glob
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.frame import Frame, OrderedFrame
from millrace.operators import stateful
from millrace.sources.rest import read_rest
from millrace.sources.sequence import read_sequence

#: Settings and the Spark settings behind them.
_SETTINGS = {
    "optimize_joins": ["spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled"],
    "broadcast_threshold": ["spark.sql.autoBroadcastJoinThreshold"],
    "shuffle_partitions": ["spark.sql.shuffle.partitions"],
    "split_bytes": ["spark.sql.files.maxPartitionBytes"],
    "skew_join": ["spark.sql.adaptive.skewJoin.enabled"],
}


class Engine:
    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark = spark or SparkSession.builder.getOrCreate()

    # ---- settings
    def set_config(self, key: str, value: object) -> None:
        """A name of this engine or any Spark SQL setting."""
        for name in _SETTINGS.get(key, [key]):
            self.spark.conf.set(name, str(value).lower() if isinstance(value, bool) else str(value))

    def get_config(self, key: str) -> str | None:
        return self.spark.conf.get(_SETTINGS.get(key, [key])[0], None)

    # ---- sources
    def read_csv(self, location: str, schema: Sequence[str] | str | None = None, has_header: bool = False, sep: str = ",") -> Frame:
        """``schema``: column names (types are inferred) or a DDL string.  Without it the file needs a header.

        A trailing separator, as in generated benchmark tables, gives a last column that a
        list of names may leave out.
        """
        if schema is None and not has_header:
            raise ValueError("give a schema or a file with a header")
        reader = self.spark.read.option("sep", sep).option("header", has_header)
        if isinstance(schema, str):
            return Frame(reader.schema(schema).csv(location))
        df = reader.option("inferSchema", True).csv(location)
        if schema is not None:
            names = list(schema)
            if len(df.columns) not in (len(names), len(names) + 1):
                raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
            df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)])
        return Frame(df)

    def read_parquet(self, location: str | Sequence[str], name_column: str | None = None) -> Frame:
        """``name_column`` adds the file's base name without ``.parquet``."""
        df = self.spark.read.parquet(*([location] if isinstance(location, str) else location))
        if name_column:
            df = df.withColumn(name_column, F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", ""))
        return Frame(df)

    def read_json(self, location: str, schema: str | None = None) -> Frame:
        reader = self.spark.read
        return Frame((reader.schema(schema) if schema else reader).json(location))

    def read_files(self, location: str) -> Frame:
        """``filename`` and ``object``, the bytes of each file."""
        return Frame(self.spark.read.format("binaryFile").load(location).select(F.col("path").alias("filename"), F.col("content").alias("object")))

    def read_sorted_parquet(self, location: str | Sequence[str], sorted_by: str, name_column: str | None = None) -> OrderedFrame:
        return self.read_parquet(location, name_column).ordered_by(sorted_by)

    def read_sorted_csv(self, location: str, sorted_by: str, schema: Sequence[str] | str | None = None, has_header: bool = False, sep: str = ",") -> OrderedFrame:
        return self.read_csv(location, schema, has_header, sep).ordered_by(sorted_by)

    def read_iceberg(self, table: str, snapshot: int | None = None) -> Frame:
        """Needs Spark's Iceberg package in the session."""
        reader = self.spark.read.format("iceberg")
        return Frame((reader.option("snapshot-id", snapshot) if snapshot is not None else reader).load(table))

    def read_delta(self, location: str, version: int | None = None) -> Frame:
        """Needs Spark's Delta package in the session."""
        reader = self.spark.read.format("delta")
        return Frame((reader.option("versionAsOf", version) if version is not None else reader).load(location))

    def read_vectors(self, location: str, vec_column: str) -> Frame:
        """Vectors from Parquet: a list column of numbers."""
        df = self.spark.read.parquet(location)
        if df.schema[vec_column].dataType.typeName() != "array":
            raise TypeError(f"{vec_column} is no list")
        return Frame(df)

    def read_rest_get(self, url: str, data: list, schema: str, headers: dict | None = None, batch_size: int = 10_000, **how) -> Frame:
        return Frame(read_rest(self.spark, "get", url, data, schema, headers, batch_size, **how))

    def read_rest_post(self, url: str, data: list, schema: str, headers: dict | None = None, batch_size: int = 10_000, **how) -> Frame:
        return Frame(read_rest(self.spark, "post", url, data, schema, headers, batch_size, **how))

    def read_sequence(self, n: int, parts: int = 4) -> Frame:
        return Frame(read_sequence(self.spark, n, parts))

    def read_dataset(self, frame: Frame) -> Frame:
        """A computed frame again."""
        return Frame(frame.df)

    def from_pandas(self, df: Any) -> Frame:
        return Frame(self.spark.createDataFrame(df))

    def from_arrow(self, table: Any) -> Frame:
        return Frame(self.spark.createDataFrame(table))

    def from_polars(self, df: Any) -> Frame:
        """Any local frame with ``to_arrow``."""
        return Frame(self.spark.createDataFrame(df.to_arrow()))

    def from_spark(self, df: DataFrame) -> Frame:
        return Frame(df)

    # ---- several inputs
    def mingle(self, sources: Sequence[Frame], operator: Callable[[], stateful.Executor], schema: str, required: Sequence[Sequence[str]] | None = None) -> Frame:
        dfs = [s.df.select(*r) for s, r in zip(sources, required)] if required else [s.df for s in sources]
        return Frame(stateful.mingle(dfs, operator, schema))

    def sql(self, text: str, **frames: Frame) -> Frame:
        """Spark SQL over named frames: ``sql("select * from {t}", t=frame)``."""
        return Frame(self.spark.sql(text, **{k: f.df for k, f in frames.items()}))

    def tables(self, folder: str) -> dict[str, Frame]:
        """Every Parquet table of a local folder by name."""
        return {p.rsplit("/", 1)[-1].removesuffix(".parquet"): self.read_parquet(p) for p in sorted(glob.glob(f"{folder}/*.parquet"))}
