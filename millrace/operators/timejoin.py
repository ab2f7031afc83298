"""As-of and range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.ticks import floor_div
from millrace.plans import merge_columns


def ordinal(df: DataFrame, name: str) -> Column:
    """A time column as a long: microseconds for dates and timestamps, the value itself for integers."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if kind in ("long", "integer", "short", "byte"):
        return F.col(name).cast("long")
    raise TypeError(f"{name} must be an integer, date or timestamp, not {kind}")


#: Rows of a key that one task may sort; a key with more is cut into spans of time.
MOST_ROWS = 1_000_000


def hot_span(df: DataFrame, key: str, at: Column) -> int | None:
    """Span of time in which the densest key has about ``MOST_ROWS`` rows; None if no key has more.

    One pass over two columns, aggregated before the shuffle.
    """
    per_key = df.select(F.col(key).alias("k"), at.alias("t")).dropna().groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t") + 1).alias("long"))
    width = per_key.filter(F.col("n") > MOST_ROWS).agg(F.min(F.col("long").cast("double") / F.col("n"))).first()[0]
    return None if width is None else max(1, int(width * MOST_ROWS))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    left_on: str,
    right_on: str,
    left_by: str,
    right_by: str,
    suffix: str = "_2",
    direction: str = "backward",
    tolerance: int | None = None,
    tie: Sequence[str] = (),
    span: int | None = None,
) -> DataFrame:
    """Every left row with the latest right row of its key at or before its time (``forward``: the earliest at or after).

    Left rows without one keep nulls; nulls of the matched row stay null.  Of right rows at
    one time the last by ``tie`` wins (forward: the first).  Null keys and times match
    nothing.  ``tolerance`` and ``span`` are in the time's unit (microseconds for timestamps).

    A key is cut into spans of time, so a hot key is many tasks: a span starts from the last
    right row before it, taken from one row per key and span.  Without ``span`` it is found from
    the densest key (``hot_span``), and keys aren't cut if none is large.
    """
    back = direction == "backward"
    if not back and direction != "forward":
        raise ValueError("direction must be backward or forward")
    sign = 1 if back else -1
    kept = [c for c in right.columns if c not in (right_on, right_by)]
    names = merge_columns(left.columns, kept, suffix)
    lt, rt = ordinal(left, left_on) * sign, ordinal(right, right_on) * sign
    # times run forward in both directions now, and "latest at or before" is the rule
    tie_key = F.struct(F.lit(0).alias("none"), *[F.col(c) for c in tie])
    r = right.select(F.col(right_by).alias("k"), rt.alias("t"), tie_key.alias("tie"), F.struct(rt.alias("at"), F.struct(*[F.col(c).alias(names[c]) for c in kept]).alias("row")).alias("r"))
    r = r.filter(F.col("k").isNotNull() & F.col("t").isNotNull())
    every = left.select(F.col(left_by).alias("k"), lt.alias("t"), F.struct(*[F.col(c) for c in left.columns]).alias("l"))
    known = F.col("k").isNotNull() & F.col("t").isNotNull()
    rows = every.filter(known)
    if span is None:
        wide = [hot_span(d, c, o) for d, c, o in ((left, left_by, ordinal(left, left_on)), (right, right_by, ordinal(right, right_on)))]
        span = min([w for w in wide if w is not None], default=None)
    part = ["k"]
    if span:
        part = ["k", "b"]
        r, rows = r.withColumn("b", floor_div(F.col("t"), span)), rows.withColumn("b", floor_div(F.col("t"), span))
    no_l, no_r = F.lit(None).cast(rows.schema["l"].dataType).alias("l"), F.lit(None).cast(r.schema["r"].dataType).alias("r")
    no_tie = F.lit(None).cast(r.schema["tie"].dataType).alias("tie")
    # of equal times right comes first, by tie; backward keeps the last of them, forward the first
    tied = F.col("tie").asc() if back else F.col("tie").desc()
    both = r.select(*part, "t", F.lit(0).alias("side"), "tie", "r", no_l).unionByName(rows.select(*part, "t", F.lit(1).alias("side"), no_tie, no_r, "l"))
    if span:
        # the right row that a span hands on: its last time, of equal ones by tie; combined before the shuffle
        if back:
            tails = r.groupBy("k", "b").agg(F.max_by("r", F.struct("t", "tie")).alias("r"))
        else:
            latest = r.groupBy("k", "b").agg(F.max(F.struct("t")).alias("top"))
            tails = r.join(latest, ["k", "b"]).filter(F.col("t") == F.col("top.t")).groupBy("k", "b").agg(F.min_by("r", "tie").alias("r"))
        spans = tails.unionByName(rows.select("k", "b").distinct().withColumn("r", no_r)).groupBy("k", "b").agg(F.first("r", ignorenulls=True).alias("r"))
        before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        carried = spans.withColumn("r", F.last("r", ignorenulls=True).over(before)).filter("r is not null")
        both = both.unionByName(carried.select("k", "b", F.lit(None).cast("long").alias("t"), F.lit(0).alias("side"), no_tie, "r", no_l))
    seq = Window.partitionBy(*part).orderBy(F.col("t").asc_nulls_first(), F.col("side"), tied).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("m", F.last("r", ignorenulls=True).over(seq)).filter("side = 1")
    row = F.col("m.row") if tolerance is None else F.when(F.col("t") - F.col("m.at") <= tolerance, F.col("m.row"))
    out = found.select("l", row.alias("row"))
    # rows that can't match stay out of the windows, where all of them would be one key
    out = out.unionByName(every.filter(~known).select("l", F.lit(None).cast(out.schema["row"].dataType).alias("row")))
    return out.select(*[F.col("l").getField(c).alias(c) for c in left.columns], *[F.col("row").getField(n).alias(n) for n in names.values()])


def range_join(left: DataFrame, right: DataFrame, *, left_on: str, right_on: str, left_by: str, right_by: str, before: int, after: int = 0, suffix: str = "_2") -> DataFrame:
    """Pairs of equal key with ``left - before <= right <= left + after``, times as in ``asof_join``.

    Both sides are cut into bins as wide as the reach; a left row looks into the bins that
    its reach touches, at most two, and a right row lies in exactly one, so the join is an
    equi-join on (key, bin) and every pair is met once.  Null keys and times match nothing.
    """
    width = max(1, before + after)
    names = merge_columns(left.columns, right.columns, suffix)
    lt, rt = ordinal(left, left_on), ordinal(right, right_on)
    touched = F.sequence(floor_div(F.col("lt") - before, width), floor_div(F.col("lt") + after, width))
    l = left.select(F.col(left_by).alias("lk"), lt.alias("lt"), F.struct(*[F.col(c) for c in left.columns]).alias("l")).filter("lk is not null and lt is not null").withColumn("bin", F.explode(touched))
    r = right.select(F.col(right_by).alias("rk"), rt.alias("rt"), F.struct(*[F.col(c).alias(names[c]) for c in right.columns]).alias("r")).withColumn("rbin", floor_div(F.col("rt"), width))
    near = (F.col("rt") >= F.col("lt") - before) & (F.col("rt") <= F.col("lt") + after)
    pairs = l.join(r, (F.col("lk") == F.col("rk")) & (F.col("bin") == F.col("rbin")) & near)
    return pairs.select(*[F.col("l").getField(c).alias(c) for c in left.columns], *[F.col("r").getField(n).alias(n) for n in names.values()])
