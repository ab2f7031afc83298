"""A REST source on Spark's Python Data Source API: one input partition per batch of requests."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _Requests(InputPartition):
    def __init__(self, items: list) -> None:
        self.items = items


class RestReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.fields = [(f.name, f.dataType.typeName()) for f in schema.fields]
        self.options = dict(options)

    def partitions(self) -> list[_Requests]:
        items = json.loads(self.options["data"])
        n = int(self.options.get("batch_size", 10_000))
        return [_Requests(items[k : k + n]) for k in range(0, len(items), n)] or [_Requests([])]

    def read(self, partition: _Requests) -> Iterator[tuple]:
        """A call is tried again ``retries`` times; one that fails for good gives no row, or with ``on_error=fail`` ends the job.  A missing field is null."""
        failed = 0
        for item in partition.items:
            for left in range(int(self.options.get("retries", 2)), -1, -1):
                try:
                    answer = self._call(item)
                    break
                except (OSError, ValueError):
                    if not left and self.options.get("on_error", "skip") == "fail":
                        raise
            else:
                failed += 1
                continue
            for row in answer if isinstance(answer, list) else [answer]:
                if isinstance(row, dict):
                    yield tuple(_typed(row.get(name), kind) for name, kind in self.fields)
        if failed:
            logging.getLogger(__name__).warning("%d of %d calls failed", failed, len(partition.items))

    def _call(self, item: object) -> object:
        o = self.options
        headers = json.loads(o.get("headers", "{}"))
        timeout = float(o.get("timeout", 30))
        if o.get("method", "get") == "get":
            with urlopen(Request(o["url"] + str(item), headers=headers), timeout=timeout) as r:
                return json.loads(r.read())
        body = json.dumps(item).encode()
        with urlopen(Request(o["url"], data=body, headers={"Content-Type": "application/json", **headers}), timeout=timeout) as r:
            got = json.loads(r.read())
        return got.get(o.get("result_field", "result"), []) if isinstance(got, dict) else got


def _typed(value: object, kind: str) -> object:
    if value is None:
        return None
    try:
        if kind in ("long", "integer", "short"):
            return int(value)
        if kind in ("double", "float"):
            return float(value)
        if kind == "string":
            return value if isinstance(value, str) else json.dumps(value)
    except (TypeError, ValueError):
        return None
    return value


class RestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_rest"

    def schema(self) -> str:
        raise ValueError("a REST source needs a schema")

    def reader(self, schema: StructType) -> RestReader:
        return RestReader(schema, self.options)


def read_rest(spark: SparkSession, method: str, url: str, data: list, schema: str, headers: dict | None = None, batch_size: int = 10_000, retries: int = 2, on_error: str = "skip") -> DataFrame:
    """GET ``url`` + item, or POST each item as JSON and take the answer's ``result``."""
    spark.dataSource.register(RestSource)
    reader = spark.read.format("millrace_rest").schema(schema).option("method", method).option("url", url)
    return reader.option("data", json.dumps(data)).option("headers", json.dumps(headers or {})).option("batch_size", batch_size).option("retries", retries).option("on_error", on_error).load()
