"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Split of a text before its merges, as published with the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def count_tokens(df: DataFrame, text: str, keep: list[str], *, vocabulary: str = DEFAULT_VOCABULARY, name: str = "tokens") -> DataFrame:
    """``keep`` and the number of tokens of ``text`` (0 for null or empty), whole texts.

    The vocabulary file is read on the driver and sent to the executors, about 1 MB.
    """
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    narrow = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]), f"`{name}` long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # kept on the worker, which later tasks use again
        known = tiktoken.__dict__.setdefault("_kept_encodings", {})
        encoding = known.get(vocabulary)
        if encoding is None:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
            encoding = known[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in batch.column(len(keep))]
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, name])

    return narrow.mapInArrow(count, schema)
