"""Clipping, quantiles, Gramian and covariance."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import percentile_name, value_frequencies, weighted_profile

#: Up to so many columns all products are sums of one aggregate; beyond, tasks multiply matrices.
_NARROW = 24
#: Columns of a block of the matrix.
_BLOCK = 512


def clip(df: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Values below or above a column's limits become the limit; null stays null."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))) for c, (lo, hi) in limits.items()})


def quantiles(df: DataFrame, columns: Sequence[str], at: float | Sequence[float], *, accuracy: int = 10_000, exact: bool = False, sample: float = 1.0) -> DataFrame:
    """One row per quantile: ``quantile`` and the columns' values.

    Approximate values are off by at most 1 / ``accuracy`` in rank; sketches merge, so the
    result doesn't depend on how the data is partitioned.  Exact ones interpolate between the two
    nearest ranks; they come from weighted values that are cut by range into slices.  Nulls
    don't count; a column without values has null.
    """
    at = [at] if isinstance(at, (int, float)) else list(at)
    df = df if sample >= 1 else df.sample(sample, seed=7)
    if exact:
        return _exact_quantiles(df, list(columns), [float(x) for x in at])
    q = F.array(*[F.lit(float(x)) for x in at])
    one = df.agg(*[F.percentile_approx(F.col(c), q, accuracy).alias(c) for c in columns])
    zipped = F.arrays_zip(F.array(*[F.lit(float(x)) for x in at]).alias("quantile"), *[F.col(c) for c in columns])
    return one.select(F.explode(zipped).alias("z")).select(F.col("z.quantile").alias("quantile"), *[F.col(f"z.{c}").alias(c) for c in columns])


def _exact_quantiles(df: DataFrame, columns: list[str], at: list[float]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(j).alias("c"), F.col(c).cast("double").alias("v")) for j, c in enumerate(columns)])
    long = df.select(F.explode(pairs).alias("p")).select("p.c", "p.v")
    names = [percentile_name(q) for q in at]
    profile = weighted_profile(value_frequencies(long, ["c"], "v"), ["c"], "v", percentiles=at)
    # one row per column of the frame
    one = profile.agg(*[F.max(F.when(F.col("c") == j, F.array(*names))).alias(c) for j, c in enumerate(columns)])
    none = F.array(*[F.lit(None).cast("double") for _ in at])
    zipped = F.arrays_zip(F.array(*[F.lit(q) for q in at]).alias("quantile"), *[F.coalesce(c, none).alias(c) for c in columns])
    return one.select(F.explode(zipped).alias("z")).select(F.col("z.quantile").alias("quantile"), *[F.col(f"z.{c}").alias(c) for c in columns])


def gramian(df: DataFrame, columns: Sequence[str], means: Sequence[float] | None = None) -> DataFrame:
    """X'X as a frame of one row per column: ``column`` and the columns.  Rows with a null in any are left out."""
    columns = list(columns)
    x = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    if means is not None:
        x = x.select(*[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(columns, means)])
    k = len(columns)
    if k <= _NARROW:
        sums = x.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)])
        rows = [F.struct(F.lit(columns[i]).alias("column"), *[F.coalesce(F.col(f"s{min(i, j)}_{max(i, j)}"), F.lit(0.0)).alias(columns[j]) for j in range(k)]) for i in range(k)]
        return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The products of all pairs of column blocks, a block's rows packed: a task yields (k / _BLOCK)² / 2 rows."""
        cuts = list(range(0, k, _BLOCK))
        totals = {(a, b): np.zeros((min(_BLOCK, k - a), min(_BLOCK, k - b))) for a in cuts for b in cuts if a <= b}
        for batch in batches:
            m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, k))
            for a, b in totals:
                totals[a, b] += m[:, a : a + _BLOCK].T @ m[:, b : b + _BLOCK]
        for (a, b), t in totals.items():
            yield pa.record_batch([pa.array([a]), pa.array([b]), pa.array([t.ravel().tobytes()], pa.binary())], names=["a", "b", "t"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the blocks of all tasks; rows of the result are cut by block."""
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for a, b, t in zip(*[c.to_pylist() for c in batch.columns]):
                block = np.frombuffer(t).reshape(min(_BLOCK, k - a), min(_BLOCK, k - b))
                sums[a, b] = sums[a, b] + block if (a, b) in sums else block
        for (a, b), t in sums.items():
            for start, other, block in ((a, b, t), *(((b, a, t.T),) if a != b else ())):
                for i, row in enumerate(block):
                    yield pa.record_batch([pa.array([start + i]), pa.array([other]), pa.array([row.tolist()], pa.list_(pa.float64()))], names=["i", "b", "v"])

    blocks = x.mapInArrow(products, "a long, b long, t binary")
    cells = blocks.repartition("a", "b").mapInArrow(add, "i long, b long, v array<double>")
    # the pieces of a row of the matrix, in order
    row = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("b", "v"))), lambda p: p["v"]))
    wide = cells.groupBy("i").agg(row.alias("v"))
    names = F.array(*[F.lit(c) for c in columns])
    return wide.select(F.element_at(names, (F.col("i") + 1).cast("int")).alias("column"), *[F.col("v")[j].alias(c) for j, c in enumerate(columns)])


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population covariance (divided by n) as a frame like ``gramian``'s, from centred columns."""
    columns = list(columns)
    x = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    means = x.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns]).first()
    n = means["n"]
    if not n:
        return gramian(x, columns)
    g = gramian(x, columns, [means[c] for c in columns])
    return g.select("column", *[(F.col(c) / n).alias(c) for c in columns])
