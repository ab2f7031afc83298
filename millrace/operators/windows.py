"""Windows over ordered streams: hopping, tumbling, sliding, session; per event or on completion."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.ticks import floor_div
from millrace.operators import timejoin
from millrace.operators.timejoin import hot_span, ordinal
from millrace.plans import fresh

Size = int | timedelta


def units(size: Size) -> int:
    """A size in the unit of ``ordinal``: microseconds of a timedelta, an integer as it is."""
    n = size // timedelta(microseconds=1) if isinstance(size, timedelta) else int(size)
    if n <= 0:
        raise ValueError("sizes must be positive")
    return n


class OnEvent:
    """A row per event, with the aggregate up to it."""


@dataclass
class OnCompletion:
    """A row per finished window.  ``delay`` is for streaming sinks (a watermark); a batch is complete."""

    delay: Size | None = None


@dataclass
class WindowSpec:
    """``aggregates`` maps a name to SQL such as ``AVG(bid)``."""

    order_by: str
    partition_by: str
    aggregates: Mapping[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str) -> WindowSpec:
        self.aggregates = {**self.aggregates, name: sql}
        return self

    def columns(self) -> list[Column]:
        return [F.expr(sql).alias(name) for name, sql in self.aggregates.items()]

    def running(self, frame: W) -> list[Column]:
        return [F.expr(sql).over(frame).alias(name) for name, sql in self.aggregates.items()]


@dataclass
class Hopping(WindowSpec):
    hop: Size = 1
    size: Size = 1


@dataclass
class Tumbling(WindowSpec):
    size: Size = 1


@dataclass
class Sliding(WindowSpec):
    """The ``size_before`` before an event, its own time included; ``closed="both"`` includes the far end too."""

    size_before: Size = 1
    closed: str = "right"


@dataclass
class Session(WindowSpec):
    """A gap longer than ``timeout`` starts a new session; one of exactly ``timeout`` doesn't."""

    timeout: Size = 1


def windowed(df: DataFrame, spec: WindowSpec, trigger: OnEvent | OnCompletion) -> DataFrame:
    """``[time, key] + aggregates``; time is the window's start (completion) or the event's time.

    Windows are aligned to the epoch; a hopping window that overlaps any event appears, also
    one that starts before the first.  Rows with a null time or key are left out.  Events at
    one time are peers: per-event results include all of them.
    """
    t, key = spec.order_by, spec.partition_by
    df = df.filter(F.col(t).isNotNull() & F.col(key).isNotNull())
    per_event = isinstance(trigger, OnEvent)
    if isinstance(spec, Sliding):
        return _sliding(df, spec)
    if isinstance(spec, Session):
        return _session(df, spec, per_event)
    hop = units(spec.hop) if isinstance(spec, Hopping) else units(spec.size)
    size = units(spec.size)
    if per_event:
        if isinstance(spec, Hopping):
            raise ValueError("hopping windows have no per-event results: an event lies in several")
        bucket = floor_div(ordinal(df, t), hop)
        frame = W.partitionBy(key, "__bucket").orderBy(ordinal(df, t)).rangeBetween(W.unboundedPreceding, 0)
        return df.withColumn("__bucket", bucket).select(t, key, *spec.running(frame))
    last = floor_div(ordinal(df, t), hop)
    if hop == size:
        starts = df.withColumn("__start", last * hop)
    else:
        first = floor_div(ordinal(df, t) - size, hop) + 1
        starts = df.withColumn("__hop", F.explode(F.sequence(first, last))).withColumn("__start", F.col("__hop") * hop)
    done = starts.groupBy("__start", key).agg(*spec.columns())
    return done.select(_as_time(df, t, F.col("__start")).alias(t), key, *spec.aggregates)


def _as_time(df: DataFrame, name: str, c: Column) -> Column:
    kind = df.schema[name].dataType
    if kind.typeName() in ("timestamp", "timestamp_ntz", "date"):
        return F.timestamp_micros(c).cast("timestamp_ntz" if kind.typeName() == "date" else kind)
    return c.cast(kind)


def _sliding(df: DataFrame, spec: Sliding) -> DataFrame:
    if spec.closed not in ("right", "both"):
        raise ValueError("closed must be right or both")
    # a hot key is cut into spans of time; the rows that a span's first rows look back on are there too
    back = units(spec.size_before) - (spec.closed == "right")
    key, t = spec.partition_by, spec.order_by
    at = ordinal(df, t)
    span = hot_span(df, key, at)
    if span is None:
        frame = W.partitionBy(key).orderBy(at).rangeBetween(-back, 0)
        return df.select(t, key, *spec.running(frame))
    span = max(span, back)
    home, part = fresh("home", df), fresh("part", df)
    rows = df.withColumn(home, floor_div(at, span)).withColumn(part, F.explode(F.sequence(F.col(home), floor_div(at + back, span))))
    frame = W.partitionBy(key, part).orderBy(ordinal(rows, t)).rangeBetween(-back, 0)
    return rows.select(home, part, t, key, *spec.running(frame)).filter(F.col(home) == F.col(part)).select(t, key, *spec.aggregates)


def _session(df: DataFrame, spec: Session, per_event: bool) -> DataFrame:
    """Sessions are numbered by the starts before them: within a span of time, and over the spans of a key."""
    t, key = spec.order_by, spec.partition_by
    at, timeout = ordinal(df, t), units(spec.timeout)
    span = hot_span(df, key, at)
    part, start, number = fresh("part", df), fresh("start", df), fresh("session", df)
    if span is None:
        seq = W.partitionBy(key).orderBy(at)
        marked = df.withColumn(start, F.when(at - F.lag(at).over(seq) <= timeout, 0).otherwise(1))
        marked = marked.withColumn(number, F.sum(start).over(seq.rangeBetween(W.unboundedPreceding, 0)))
    else:
        cut = df.withColumn(part, floor_div(at, span))
        k, p, before = fresh("k", cut), fresh("p", cut), fresh("before", cut)
        of_key = W.partitionBy(k).orderBy(p)
        on = (F.col(key) == F.col(k)) & (F.col(part) == F.col(p))
        # one row per key and span: the last time before it
        ends = cut.groupBy(F.col(key).alias(k), F.col(part).alias(p)).agg(F.max(ordinal(cut, t)).alias("end")).select(k, p, F.lag("end").over(of_key).alias(before))
        cut = cut.join(ends, on).drop(k, p)
        seq = W.partitionBy(key, part).orderBy(ordinal(cut, t))
        last = F.coalesce(F.lag(ordinal(cut, t)).over(seq), F.col(before))
        cut = cut.withColumn(start, F.when(ordinal(cut, t) - last <= timeout, 0).otherwise(1)).drop(before)
        starts = cut.groupBy(F.col(key).alias(k), F.col(part).alias(p)).agg(F.sum(start).alias("n"))
        starts = starts.select(k, p, F.coalesce(F.sum("n").over(of_key.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before))
        cut = cut.join(starts, on).drop(k, p)
        marked = cut.withColumn(number, F.col(before) + F.sum(start).over(seq.rangeBetween(W.unboundedPreceding, 0))).drop(before)
    if per_event:
        frame = W.partitionBy(key, number).orderBy(ordinal(marked, t)).rangeBetween(W.unboundedPreceding, 0)
        return marked.select(t, key, *spec.running(frame))
    return marked.groupBy(key, number).agg(F.min(t).alias(t), *spec.columns()).select(t, key, *spec.aggregates)


def shift(df: DataFrame, columns: list[str], n: int, *, by: str, order_by: str, fill: object = None, tie: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``<c>_shifted``: the value ``n`` rows before in the key's order (after, where ``n`` is negative).

    The rows of a hot key are numbered span by span and cut into stretches of many rows, of which each also holds the
    ``n`` rows beside it.
    """
    f = F.lag if n >= 0 else F.lead
    kind = df.schema[order_by].dataType.typeName()
    span = hot_span(df, by, ordinal(df, order_by)) if kind in ("timestamp", "timestamp_ntz", "date", "long", "integer", "short", "byte") else None
    if span is None:
        seq = W.partitionBy(by).orderBy(order_by, *tie)
        return df.withColumns({f"{c}_shifted": f(c, abs(n), fill).over(seq) for c in columns})
    part, nth, home, piece = (fresh(x, df) for x in ("part", "nth", "home", "piece"))
    before = fresh("before", df)
    # null times come first, as in the order above
    cut = df.withColumn(part, F.coalesce(floor_div(ordinal(df, order_by), span), F.lit(-(2**62))))
    counts = cut.groupBy(by, part).agg(F.count(F.lit(1)).alias(nth))
    counts = counts.select(F.col(by).alias(home), F.col(part).alias(piece), F.coalesce(F.sum(nth).over(W.partitionBy(by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before))
    numbered = cut.join(counts, F.col(by).eqNullSafe(F.col(home)) & (F.col(part) == F.col(piece))).drop(home, piece)
    numbered = numbered.withColumn(nth, F.col(before) + F.row_number().over(W.partitionBy(by, part).orderBy(order_by, *tie)) - 1)
    size = max(timejoin.MOST_ROWS, abs(n))
    rows = numbered.withColumn(home, floor_div(F.col(nth), size))
    ends = floor_div(F.col(nth) + n, size)
    rows = rows.withColumn(piece, F.explode(F.array_distinct(F.array(F.col(home), ends))))
    seq = W.partitionBy(by, piece).orderBy(nth)
    rows = rows.withColumns({f"{c}_shifted": f(c, abs(n), fill).over(seq) for c in columns}).filter(F.col(home) == F.col(piece))
    return rows.select(*df.columns, *[f"{c}_shifted" for c in columns])
