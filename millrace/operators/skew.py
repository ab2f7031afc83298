"""Exact results per key when a few keys hold most rows.

Method: value-frequency compression.  Rows are first counted per (key, value), with a
partial aggregate before the shuffle, so a hot key is spread over its values and repeats
never leave the mapper.  Distinct counts, modes and sums follow from the weighted values
by aggregates that again combine before the shuffle.  Percentiles need the values of a key
in order: those are cut by range into even slices, a hot key over several, and every
slice learns from a small table of slice weights how much of its key lies before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans import durable


def value_frequencies(df: DataFrame, keys: Sequence[str], value: str, *, weight: str = "weight") -> DataFrame:
    """``keys``, ``value`` and the number of rows that have them; null values are left out, null keys are a key."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(weight))


def weighted_profile(
    frequencies: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    weight: str = "weight",
    percentiles: Sequence[float] = (),
    bounded: bool = False,
) -> DataFrame:
    """One row per key from its weighted values.

    Columns: ``keys``, ``n`` (rows), ``n_distinct``, ``mode`` (the most frequent value, of
    equally frequent ones the least) and ``p<percent>`` for each of ``percentiles`` (0..1),
    interpolated between the two nearest ranks as SQL's ``percentile_cont`` does.
    ``bounded`` says that the values come from a fixed grid, so a key has few different ones
    and needs no slices.
    Defined cases: a null key is a key of its own; NaN is a value above all others; -0.0
    and 0.0 are one value; a key without non-null values has no row; no rows, no keys.
    """
    keys = list(keys)
    narrow = frequencies.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).alias("v"), F.col(weight).alias("w"))
    ks = [f"k{i}" for i in range(len(keys))]
    if percentiles and bounded:
        of_key = Window.partitionBy(*ks)
        narrow = narrow.withColumns({"n": F.sum("w").over(of_key), "upto": F.sum("w").over(of_key.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))})
    elif percentiles:
        narrow = _placed(durable(narrow.repartitionByRange(*ks, "v").withColumn("slice", F.spark_partition_id())), ks)
    # of the greatest weight the least value: a min over a struct, combined before the shuffle
    mode = F.min(F.struct((-F.col("w")).alias("w"), F.col("v"))).getField("v")
    aggs = [F.sum("w").alias("n"), F.count(F.lit(1)).alias("n_distinct"), mode.alias("mode")]
    for j, p in enumerate(percentiles):
        rank = (F.col("n") - 1) * F.lit(float(p))
        aggs += [_at(F.floor(rank)).alias(f"lo_{j}"), _at(F.ceil(rank)).alias(f"hi_{j}")]
    out = narrow.groupBy(*ks).agg(*aggs)

    def between(j: int, p: float) -> Column:
        rank = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"lo_{j}").cast("double"), F.col(f"hi_{j}").cast("double")
        # equal ends need no arithmetic, which also keeps infinities
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (rank - F.floor(rank))).alias(percentile_name(p))

    names = [F.col(f"k{i}").alias(k) for i, k in enumerate(keys)]
    return out.select(*names, "n", "n_distinct", "mode", *[between(j, p) for j, p in enumerate(percentiles)])


def percentile_name(p: float) -> str:
    return f"p{round(p * 100, 4):g}".replace(".", "_")


def _at(rank: Column) -> Column:
    """The value that holds a rank (from 0) of its key."""
    return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("w") <= rank), F.col("v")))


def _placed(sliced: DataFrame, ks: list[str]) -> DataFrame:
    """Every weighted value with the weight of its key up to it and in all."""
    per_slice = sliced.groupBy(*ks, "slice").agg(F.sum("w").alias("held"))
    of_key = Window.partitionBy(*ks)
    before = F.sum("held").over(of_key.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_slice.select(*[F.col(k).alias(f"{k}_r") for k in ks], F.col("slice").alias("slice_r"), F.coalesce(before, F.lit(0)).alias("before"), F.sum("held").over(of_key).alias("n"))
    # one row per key and slice on the right; null keys are keys
    on = [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in [*ks, "slice"]]
    placed = sliced.join(offsets, on).select(*ks, "slice", "v", "w", "before", "n")
    upto = F.sum("w").over(Window.partitionBy(*ks, "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("upto", F.col("before") + upto)
