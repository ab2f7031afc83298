"""Collapse runs of nearly equal consecutive events into one event with count and duration.

Method: adjacent agglomeration.  The events of an entity form a linked list of runs; a
priority queue holds the neighbouring runs that meet the similarity and gap limits, the
most similar on top, and merges until it is empty.  The similarity of two neighbouring
runs is that of the two events that face each other, so a merge changes no other entry
of the queue and the outcome does not depend on where the list was cut.

Scale: the list is cut by range into sorted slices of even size, whatever the entities'
sizes: a hot entity spans several slices.  A slice is read batch by batch; only the open
run is carried over.  Runs that touch a slice's ends (at most two per slice) are written
with the others and merged in a second pass over those few rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans import durable, fresh

INSIDE, HEAD, TAIL, BOTH = 0, 1, 2, 3


def collapse_runs(
    events: DataFrame,
    *,
    by: Sequence[str],
    time: str,
    id: str,
    limits: Mapping[str, float],
    max_gap: int,
    min_count: int = 1,
) -> DataFrame:
    """One row per run of consecutive events of an entity that agree in all fields of ``limits``.

    Order is ``time``, then ``id``.  An event joins the run before it if both have the same
    ``by``, lie at most ``max_gap`` apart and differ by at most ``limits[f]`` in each field.
    Result: ``by``, ``first_<id>``, ``last_<id>``, ``first_<time>``, ``last_<time>``,
    ``n_events``, ``duration`` and ``first_<field>`` for each field.  Defined cases:

    * a null field agrees with a null only, NaN agrees with nothing, not even NaN;
    * rows with a null in ``by``, ``time`` or ``id`` are left out;
    * rows that repeat ``by``, ``time`` and ``id`` count once;
    * runs of fewer than ``min_count`` events are left out;
    * other columns are not read, whatever their names; an empty table gives no rows.
    """
    by, fields = list(by), list(limits)
    tolerance = [float(limits[f]) for f in fields]
    types = {c: events.schema[c].dataType for c in [*by, *fields]}
    cols = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    cols += [F.col(time).cast("long").alias("t"), F.col(id).cast("long").alias("i")]
    cols += [F.col(c).alias(f"v{j}") for j, c in enumerate(fields)]
    keys = [f"k{i}" for i in range(len(by))]
    values = [f"v{j}" for j in range(len(fields))]
    narrow = events.select(*cols).dropna(subset=[*keys, "t", "i"])
    order = [*keys, "t", "i"]
    slices = narrow.repartitionByRange(*order).sortWithinPartitions(*order)

    schema = T.StructType(
        [T.StructField(f"k{i}", types[c]) for i, c in enumerate(by)]
        + [T.StructField(c, T.LongType()) for c in ("t", "i", "t_last", "i_last", "n", "slice")]
        + [T.StructField("edge", T.IntegerType())]
        + [T.StructField(f"v{j}", types[c]) for j, c in enumerate(fields)]
        + [T.StructField(f"v{j}_last", types[c]) for j, c in enumerate(fields)]
    )
    pieces = durable(slices.mapInArrow(_Agglomerate(keys, values, tolerance, max_gap, min_count), schema))

    # a slice has at most a first and a last piece; times of different entities say nothing about their order
    seam = Window.partitionBy().orderBy("slice", "edge")

    def near(j: int) -> Column:
        a, b = F.lag(f"v{j}_last").over(seam), F.col(f"v{j}")
        both = a.isNotNull() & b.isNotNull() & (F.abs(b.cast("double") - a.cast("double")) <= tolerance[j])
        if isinstance(types[fields[j]], (T.DoubleType, T.FloatType)):
            both &= ~F.isnan(a) & ~F.isnan(b)
        return (a.isNull() & b.isNull()) | both

    same = [F.lag(k).over(seam) == F.col(k) for k in keys]
    facing = [F.lag("edge").over(seam).isin(TAIL, BOTH), F.col("edge").isin(HEAD, BOTH)]
    gap = F.col("t") - F.lag("t_last").over(seam) <= max_gap
    linked = reduce(lambda a, b: a & b, [*same, *facing, gap, *[near(j) for j in range(len(fields))]])
    edges = pieces.filter(F.col("edge") != INSIDE).withColumn("new", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1))
    edges = edges.withColumn("run", F.sum("new").over(seam.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.struct("slice", "edge")
    merged = edges.groupBy("run", *keys).agg(
        F.min("t").alias("t"),
        F.min_by("i", start).alias("i"),
        F.max("t_last").alias("t_last"),
        F.max_by("i_last", start).alias("i_last"),
        F.sum("n").alias("n"),
        *[F.min_by(v, start).alias(v) for v in values],
    )
    shape = [*keys, "t", "i", "t_last", "i_last", "n", *values]
    runs = pieces.filter(F.col("edge") == INSIDE).select(*shape).unionByName(merged.select(*shape)).filter(F.col("n") >= min_count)
    return runs.select(
        *[F.col(k).alias(c) for k, c in zip(keys, by)],
        F.col("i").alias(f"first_{id}"),
        F.col("i_last").alias(f"last_{id}"),
        F.col("t").alias(f"first_{time}"),
        F.col("t_last").alias(f"last_{time}"),
        F.col("n").alias(fresh("n_events", by).removeprefix("__")),
        (F.col("t_last") - F.col("t")).alias("duration"),
        *[F.col(v).alias(f"first_{f}") for v, f in zip(values, fields)],
    )


def agglomerate(distance: np.ndarray) -> np.ndarray:
    """First positions of the runs of ``len(distance) + 1`` events.

    ``distance[b]`` is that of events b and b + 1 in units of the limits, above 1 or NaN
    where they may not merge.  The linked list is kept as the far end of each run, stored
    at both of its ends.
    """
    n = len(distance) + 1
    far = list(range(n))
    is_head = np.ones(n, dtype=bool)
    may = np.flatnonzero(distance <= 1)
    queue = list(zip(distance[may].tolist(), (may + 1).tolist()))
    heapq.heapify(queue)
    while queue:
        _, b = heapq.heappop(queue)
        head, tail = far[b - 1], far[b]
        far[head], far[tail] = tail, head
        is_head[b] = False
    return np.flatnonzero(is_head)


class _Agglomerate:
    """Reads one sorted slice and yields its runs, the two at its ends marked."""

    def __init__(self, keys: list[str], values: list[str], tolerance: list[float], max_gap: int, min_count: int) -> None:
        self.keys, self.values, self.tolerance, self.max_gap, self.min_count = keys, values, tolerance, max_gap, min_count

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        me = context.partitionId() if context else 0
        held: pa.Table | None = None  # the open run: its first and last event
        held_n, at_head = 0, True
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held.slice(1, 1), rows])
            rows = rows.combine_chunks()
            again = self._again(rows)
            if again.any():
                rows = rows.filter(pa.array(np.concatenate([[True], ~again]))).combine_chunks()
            if not rows.num_rows:
                continue
            heads = agglomerate(self._distance(rows))
            tails = np.append(heads[1:], rows.num_rows) - 1
            n = tails - heads + 1
            first, last = rows.take(pa.array(heads)), rows.take(pa.array(tails))
            if held is not None:  # the first run goes on from the open one, whose last event is row 0
                n[0] += held_n - 1
                first = pa.concat_tables([held.slice(0, 1), first.slice(1)])
            closed = len(heads) - 1
            if closed:
                edge = np.zeros(closed, dtype=np.int32)
                if at_head:
                    edge[0] = HEAD
                at_head = False
                yield from self._emit(first.slice(0, closed), last.slice(0, closed), n[:closed], edge, me)
            held = pa.concat_tables([first.slice(closed, 1), last.slice(closed, 1)])
            held_n = int(n[closed])
        if held is not None:
            edge = np.array([BOTH if at_head else TAIL], dtype=np.int32)
            yield from self._emit(held.slice(0, 1), held.slice(1, 1), np.array([held_n]), edge, me)

    def _column(self, rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        col = rows.column(name)
        null = col.is_null().to_numpy()
        if null.any():
            col = col.fill_null(0)
        return col.to_numpy(), null

    def _same(self, rows: pa.Table, names: list[str]) -> np.ndarray:
        same = np.ones(max(0, rows.num_rows - 1), dtype=bool)
        for c in names:
            v = rows.column(c).to_numpy()
            same &= v[1:] == v[:-1]
        return same

    def _again(self, rows: pa.Table) -> np.ndarray:
        return self._same(rows, ["i", "t", *self.keys])

    def _distance(self, rows: pa.Table) -> np.ndarray:
        t = rows.column("t").to_numpy()
        apart = np.where(self._same(rows, self.keys) & (np.diff(t) <= self.max_gap), 0.0, np.inf)
        with np.errstate(invalid="ignore", over="ignore"):
            for name, most in zip(self.values, self.tolerance):
                v, null = self._column(rows, name)
                d = np.abs(v[1:].astype("float64") - v[:-1].astype("float64"))
                # a difference within the limit has at most distance 1, without rounding of a quotient
                d = np.where(d <= most, np.minimum(d / most if most else 0 * d, 1.0), np.inf)
                d = np.where(null[1:] | null[:-1], np.where(null[1:] & null[:-1], 0.0, np.inf), d)
                apart = np.maximum(apart, d)
        return apart

    def _emit(self, first: pa.Table, last: pa.Table, n: np.ndarray, edge: np.ndarray, me: int) -> Iterator[pa.RecordBatch]:
        cols = {k: first.column(k) for k in self.keys}
        cols |= {"t": first.column("t"), "i": first.column("i"), "t_last": last.column("t"), "i_last": last.column("i")}
        cols |= {"n": pa.array(n, pa.int64()), "slice": pa.array(np.full(len(n), me, dtype=np.int64)), "edge": pa.array(edge, pa.int32())}
        cols |= {v: first.column(v) for v in self.values} | {f"{v}_last": last.column(v) for v in self.values}
        out = pa.table(cols)
        keep = (n >= self.min_count) | (edge != INSIDE)
        if not keep.all():
            out = out.filter(pa.array(keep))
        yield from out.combine_chunks().to_batches()
