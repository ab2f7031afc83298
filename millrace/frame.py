"""The lazy frame API: thin, immutable wrappers of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expr import Expr, raw
from millrace.functions.sqltext import aliased, split_list
from millrace.operators import stats, stateful, timejoin, vectors, windows
from millrace.operators.patterns import match_pattern
from millrace.plans import broadcast_if_small, durable, merge_columns

_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "avg": F.avg, "count": F.count, "std": F.stddev_samp, "variance": F.var_samp, "count_distinct": F.count_distinct}
_JOINS = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti", "right": "right", "full": "full", "outer": "full"}


def _list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _need(df: DataFrame, names: Sequence[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")


def aggregates(df: DataFrame, spec: Mapping[str, str | Sequence[str]]) -> list[Column]:
    """``{"x": ["sum", "avg"], "*": "count"}`` as columns ``x_sum``, ``x_avg``, ``count``; booleans add up as 0 and 1."""
    out = []
    for column, functions in spec.items():
        for f in _list(functions):
            if column == "*":
                if f != "count":
                    raise ValueError("* can only be counted")
                out.append(F.count(F.lit(1)).alias("count"))
                continue
            _need(df, [column])
            if f not in _AGGREGATES:
                raise ValueError(f"no aggregate {f!r}; there are {', '.join(_AGGREGATES)}")
            c = F.col(column)
            if df.schema[column].dataType.typeName() == "boolean" and f in ("sum", "mean", "avg"):
                c = c.cast("int")
            out.append(_AGGREGATES[f](c).alias(f"{column}_{f}"))
    return out


class Frame:
    """A lazy table.  Every method returns a new frame; nothing runs before an action."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    # ---- looking at it
    @property
    def schema(self) -> list[str]:
        return self.df.columns

    def __getitem__(self, name: str) -> Expr:
        _need(self.df, [name])
        return Expr(F.col(name))

    def __repr__(self) -> str:
        return f"{type(self).__name__}[{', '.join(self.schema)}]"

    def _new(self, df: DataFrame) -> Frame:
        return Frame(df)

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def collect(self) -> pd.DataFrame:
        return self.df.toPandas()

    def to_arrow(self) -> Any:
        return self.df.toArrow()

    def to_dict(self) -> dict[str, list]:
        return self.df.toArrow().to_pydict()

    def length(self) -> int:
        return self.df.count()

    def compute(self) -> Frame:
        """Run now and keep the result in the shared folder, for any number of later uses."""
        return self._new(durable(self.df))

    # ---- rows and columns
    def select(self, columns: Sequence[str]) -> Frame:
        _need(self.df, list(columns))
        return self._new(self.df.select(*columns))

    def drop(self, columns: Sequence[str]) -> Frame:
        """Unknown names are ignored."""
        return self._new(self.df.drop(*_list(columns)))

    def rename(self, names: Mapping[str, str]) -> Frame:
        _need(self.df, list(names))
        clash = [n for n in names.values() if n in self.df.columns]
        if clash or len(set(names.values())) < len(names):
            raise ValueError(f"names in use: {', '.join(clash) or 'twice in the new ones'}")
        return self._new(self.df.withColumnsRenamed(dict(names)))

    def filter(self, condition: Expr | Column) -> Frame:
        return self._new(self.df.filter(raw(condition)))

    def filter_sql(self, predicate: str) -> Frame:
        return self._new(self.df.filter(F.expr(predicate)))

    def with_columns(self, new: Mapping[str, Expr | Column | Callable], required: Sequence[str] | None = None, types: Mapping[str, str] | None = None) -> Frame:
        """New columns from expressions, or from functions of a pandas frame of ``required`` that give a series of ``types[name]``."""
        clash = [n for n in new if n in self.df.columns]
        if clash:
            raise ValueError(f"columns exist: {', '.join(clash)}")
        made = {}
        for name, how in new.items():
            if isinstance(how, (Expr, Column)):
                made[name] = raw(how)
            else:
                kind = (types or {}).get(name)
                if kind is None:
                    raise ValueError(f"{name}: a function needs its type in types")
                made[name] = _series(how, kind, self.df, list(required or self.df.columns))
        return self._new(self.df.withColumns(made))

    def with_columns_sql(self, text: str) -> Frame:
        """``"a + b as c, upper(d) as e"``."""
        return self.with_columns({name: F.expr(sql) for sql, name in aliased(text)})

    def transform(self, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, required: Sequence[str] | None = None) -> Frame:
        return Frame(stateful.map_batches(self.df, f, schema, list(required) if required else None))

    def transform_sql(self, text: str, groupby: Sequence[str] = ()) -> Frame:
        """The expressions over the whole table, per group with ``groupby``; Catalyst splits aggregates in two steps itself."""
        items = [F.expr(sql).alias(name) for sql, name in aliased(text)]
        return Frame(self.df.groupBy(*groupby).agg(*items) if groupby else self.df.select(*items))

    def clip(self, limits: Mapping[str, tuple[float, float]]) -> Frame:
        _need(self.df, list(limits))
        return self._new(stats.clip(self.df, limits))

    def union(self, other: Frame) -> Frame:
        if set(self.schema) != set(other.schema):
            raise ValueError("both sides need the same columns")
        return self._new(self.df.unionByName(other.df))

    def intersect(self, other: Frame) -> Frame:
        return Frame(self.df.intersect(other.df.select(*self.schema)))

    def except_all(self, other: Frame) -> Frame:
        return Frame(self.df.exceptAll(other.df.select(*self.schema)))

    def distinct(self, keys: str | Sequence[str]) -> Frame:
        return Frame(self.df.select(*_list(keys)).distinct())

    def partition(self, keys: str | Sequence[str] = (), n: int | None = None, how: str = "hash") -> Frame:
        """Where the rows lie: by ``hash`` or ``range`` of keys, or evenly over ``n`` partitions without keys.

        Later joins and groups on the same hashed keys need no further shuffle.
        """
        if how not in ("hash", "range"):
            raise ValueError("how must be hash or range")
        keys = _list(keys)
        _need(self.df, keys)
        args = [*([n] if n else []), *keys]
        if not args:
            raise ValueError("give keys or a number of partitions")
        return self._new((self.df.repartition if how == "hash" else self.df.repartitionByRange)(*args))

    # ---- joins
    def join(
        self, right: Frame, on: str | None = None, left_on: str | None = None, right_on: str | None = None, suffix: str = "_2", how: str = "inner", maintain_sort_order: str | Sequence[str] | None = None, broadcast_rows: int = 0
    ) -> Frame:
        """Equi-join on one or more keys; left columns, then right ones without its keys, a clash with ``suffix``.

        Keys are lists too.  Null keys match nothing.  ``right`` and ``full`` keep the key of
        either side.  ``maintain_sort_order``: ``"left"`` or ``"right"`` gives a frame in the order
        of that side's time column (the order is made where it is needed), names of columns sort the result.
        The right side is sent to all executors if it is counted to have at most ``broadcast_rows``
        rows; else the planner decides by size.
        """
        lk, rk = _list(left_on or on), _list(right_on or on)
        if how not in _JOINS:
            raise ValueError(f"how must be one of {', '.join(_JOINS)}")
        _need(self.df, lk)
        _need(right.df, rk)
        kept = [c for c in right.schema if c not in rk]
        names = merge_columns(self.schema, kept, suffix)
        source = broadcast_if_small(right.df, broadcast_rows) if broadcast_rows else right.df
        r = source.select(*[F.col(c).alias(f"__key{i}") for i, c in enumerate(rk)], *[F.col(c).alias(names[c]) for c in kept])
        on_keys = [F.col(c) == F.col(f"__key{i}") for i, c in enumerate(lk)]
        out = self.df.join(r, on_keys, _JOINS[how])
        if how in ("right", "full", "outer"):
            out = out.withColumns({c: F.coalesce(c, f"__key{i}") for i, c in enumerate(lk)})
        out = out.drop(*[f"__key{i}" for i in range(len(rk))])
        if maintain_sort_order in ("left", "right"):
            side = self if maintain_sort_order == "left" else right
            if not isinstance(side, OrderedFrame):
                raise ValueError(f"the {maintain_sort_order} frame has no order")
            return OrderedFrame(out, side.time if side is self else names.get(side.time, lk[rk.index(side.time)] if side.time in rk else side.time))
        return self._new(out.orderBy(*_list(maintain_sort_order)) if maintain_sort_order else out)

    def join_on(self, right: Frame, condition: str, how: str = "inner") -> Frame:
        """Any condition over ``l.column`` and ``r.column``; the result has left columns for semi and anti, else all with ``_2`` on clashes."""
        l, r = self.df.alias("l"), right.df.alias("r")
        j = l.join(r, F.expr(condition), _JOINS[how])
        if how in ("semi", "anti"):
            return Frame(j.select(*[F.col(f"l.{c}") for c in self.schema]))
        names = merge_columns(self.schema, right.schema, "_2")
        return Frame(j.select(*[F.col(f"l.{c}") for c in self.schema], *[F.col(f"r.{c}").alias(n) for c, n in names.items()]))

    def cross(self, right: Frame) -> Frame:
        return Frame(self.df.crossJoin(right.df))

    def vector_nn_join(self, probe: Frame, vec_column: str | None = None, vec_column_left: str | None = None, vec_column_right: str | None = None, k: int = 1, probe_side: str = "right", suffix: str = "_probe") -> Frame:
        """``probe_side="right"``: for every probe vector the ``k`` rows of this frame; ``"left"``: for every row here the ``k`` of the other."""
        left, right = vec_column_left or vec_column, vec_column_right or vec_column
        if probe_side == "right":
            return Frame(vectors.vector_join(self.df, probe.df, left=left, right=right, k=k, suffix=suffix))
        return Frame(vectors.vector_join(probe.df, self.df, left=right, right=left, k=k, suffix=suffix))

    def vector_index(self, vec_column: str, **how) -> IndexedVectors:
        """This frame in an index of its vectors (see ``VectorIndex``), for approximate searches."""
        index = vectors.VectorIndex.fit(self.df, vec_column, **how)
        return IndexedVectors(index, durable(index.assign(self.df, vec_column)), vec_column)

    def vector_range_join(self, probe: Frame, vec_column: str, least: float, suffix: str = "_probe") -> Frame:
        return Frame(vectors.vector_join(self.df, probe.df, left=vec_column, right=vec_column, k=None, least=least, suffix=suffix))

    # ---- aggregation
    def groupby(self, keys: str | Sequence[str], orderby: Sequence | None = None) -> GroupedFrame:
        return GroupedFrame(self.df, _list(keys), orderby)

    def cube(self, keys: Sequence[str], aggregates_sql: str) -> Frame:
        return Frame(self.df.cube(*keys).agg(*[F.expr(s).alias(n) for s, n in aliased(aggregates_sql)]))

    def rollup(self, keys: Sequence[str], aggregates_sql: str) -> Frame:
        return Frame(self.df.rollup(*keys).agg(*[F.expr(s).alias(n) for s, n in aliased(aggregates_sql)]))

    def agg(self, spec: Mapping[str, str | Sequence[str]]) -> Frame:
        return Frame(self.df.agg(*aggregates(self.df, spec)))

    aggregate = agg

    def agg_sql(self, text: str) -> Frame:
        return Frame(self.df.agg(*[F.expr(sql).alias(name) for sql, name in aliased(text)]))

    def count_distinct(self, column: str) -> Frame:
        return Frame(self.df.agg(F.count_distinct(column).alias(column)))

    def count(self) -> Frame:
        return Frame(self.df.agg(F.count(F.lit(1)).alias("count")))

    def _each(self, columns: str | Sequence[str], f: str) -> Frame:
        return self.agg({c: f for c in _list(columns)})

    def sum(self, columns: str | Sequence[str]) -> Frame:
        return self._each(columns, "sum")

    def min(self, columns: str | Sequence[str]) -> Frame:
        return self._each(columns, "min")

    def max(self, columns: str | Sequence[str]) -> Frame:
        return self._each(columns, "max")

    def mean(self, columns: str | Sequence[str]) -> Frame:
        return self._each(columns, "mean")

    def top_k(self, columns: Sequence[str], k: int, descending: bool | Sequence[bool] = True, tie: Sequence[str] = ()) -> Frame:
        """The first ``k`` rows in that order; without ``tie`` equal rows are taken in any order."""
        columns = _list(columns)
        down = [descending] * len(columns) if isinstance(descending, bool) else list(descending)
        return Frame(self.df.orderBy(*[F.col(c).desc() if d else F.col(c).asc() for c, d in zip(columns, down)], *tie).limit(k))

    def sort(self, columns: Sequence[str], descending: bool = False) -> Frame:
        return Frame(self.df.orderBy(*[F.col(c).desc() if descending else F.col(c) for c in _list(columns)]))

    def limit(self, n: int) -> Frame:
        return self._new(self.df.limit(n))

    def approximate_quantile(self, columns: str | Sequence[str], quantiles: float | Sequence[float], sample_factor: float = 1) -> Frame:
        return Frame(stats.quantiles(self.df, _list(columns), quantiles, sample=sample_factor))

    def approximate_median(self, columns: str | Sequence[str]) -> Frame:
        return self.approximate_quantile(columns, 0.5)

    def quantile(self, columns: str | Sequence[str], quantiles: float | Sequence[float]) -> Frame:
        """Exact, interpolated."""
        return Frame(stats.quantiles(self.df, _list(columns), quantiles, exact=True))

    def gramian(self, columns: Sequence[str], demean: Sequence[float] | None = None) -> Frame:
        return Frame(stats.gramian(self.df, columns, demean))

    def covariance(self, columns: Sequence[str]) -> Frame:
        return Frame(stats.covariance(self.df, columns))

    # ---- Python operators
    def stateful_transform(self, executor: Callable[[], stateful.Executor], schema: str, required: Sequence[str] | None = None, by: str | None = None, partitions: int | None = None) -> Frame:
        return Frame(stateful.run_executor(self.df, executor, schema, columns=list(required) if required else None, by=by, partitions=partitions))

    # ---- sinks
    def write_csv(self, location: str, output_line_limit: int = 1_000_000, mode: str = "error", header: bool = True) -> Frame:
        """Files of at most so many lines; the result lists them."""
        self.df.write.mode(mode).option("maxRecordsPerFile", output_line_limit).option("header", header).csv(location)
        return self._listing(location, "csv")

    def write_parquet(self, location: str, output_line_limit: int = 5_000_000, mode: str = "error", partition_by: Sequence[str] = ()) -> Frame:
        w = self.df.write.mode(mode).option("maxRecordsPerFile", output_line_limit)
        (w.partitionBy(*partition_by) if partition_by else w).parquet(location)
        return self._listing(location, "parquet")

    def _listing(self, location: str, ending: str) -> Frame:
        files = self.df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{ending}").load(location)
        return Frame(files.select(F.col("path").alias("filename")))

    # ---- order
    def ordered_by(self, time: str) -> OrderedFrame:
        return OrderedFrame(self.df, time)


class OrderedFrame(Frame):
    """A frame with a time column.  The order is made where an operator needs it, not kept physically."""

    def __init__(self, df: DataFrame, time: str) -> None:
        super().__init__(df)
        _need(df, [time])
        self.time = time

    def _new(self, df: DataFrame) -> Frame:
        return OrderedFrame(df, self.time) if self.time in df.columns else Frame(df)

    def drop(self, columns: Sequence[str]) -> Frame:
        if self.time in _list(columns):
            raise ValueError(f"{self.time} is the order of this frame")
        return super().drop(columns)

    def rename(self, names: Mapping[str, str]) -> Frame:
        got = super().rename(names)
        return OrderedFrame(got.df, names.get(self.time, self.time))

    def select(self, columns: Sequence[str]) -> Frame:
        _need(self.df, list(columns))
        return self._new(self.df.select(*columns))

    def join_asof(
        self, right: OrderedFrame, by: str | None = None, left_by: str | None = None, right_by: str | None = None, suffix: str = "_2", direction: str = "backward", tolerance: windows.Size | None = None, tie: Sequence[str] = (), span: windows.Size | None = None
    ) -> Frame:
        tol = None if tolerance is None else windows.units(tolerance)
        got = timejoin.asof_join(
            self.df, right.df, left_on=self.time, right_on=right.time, left_by=left_by or by, right_by=right_by or by, suffix=suffix, direction=direction, tolerance=tol, tie=tie, span=None if span is None else windows.units(span)
        )
        return OrderedFrame(got, self.time)

    def join_range(self, right: OrderedFrame, by: str, before: windows.Size, after: windows.Size | None = None, suffix: str = "_2") -> Frame:
        return OrderedFrame(
            timejoin.range_join(self.df, right.df, left_on=self.time, right_on=right.time, left_by=by, right_by=by, before=windows.units(before), after=windows.units(after) if after else 0, suffix=suffix), self.time
        )

    def windowed_transform(self, window: windows.WindowSpec, trigger: windows.OnEvent | windows.OnCompletion) -> Frame:
        if window.order_by != self.time:
            raise ValueError(f"this frame is ordered by {self.time}, the window by {window.order_by}")
        return OrderedFrame(windows.windowed(self.df, window, trigger), self.time)

    def shift(self, columns: str | Sequence[str], n: int, by: str, fill_value: object = None, tie: Sequence[str] = ()) -> Frame:
        return self._new(windows.shift(self.df, _list(columns), n, by=by, order_by=self.time, fill=fill_value, tie=tuple(tie)))

    def pattern_recognize(self, events: Sequence[tuple[str, str]], maxspan: windows.Size, by: str, id: str, all_matches: bool = False) -> Frame:
        return Frame(match_pattern(self.df, time=self.time, by=by, events=events, span=maxspan, id=id, first_only=not all_matches))

    def stateful_transform(self, executor: Callable[[], stateful.Executor], schema: str, required: Sequence[str] | None = None, by: str | None = None, partitions: int | None = None) -> Frame:
        columns = list(dict.fromkeys([*required, *([by] if by else []), self.time])) if required else None
        return Frame(stateful.run_executor(self.df, executor, schema, columns=columns, by=by, order_by=[self.time], partitions=partitions))


class GroupedFrame:
    """Groups waiting for aggregates.  ``orderby``: keys, or (key, "asc" | "desc"); the order is of the whole result."""

    def __init__(self, df: DataFrame, keys: list[str], orderby: Sequence | None) -> None:
        _need(df, keys)
        self.df, self.keys, self.order = df, keys, []
        for o in orderby or []:
            name, way = (o, "asc") if isinstance(o, str) else o
            if name not in keys or way not in ("asc", "desc"):
                raise ValueError("orderby names group keys, each asc or desc")
            self.order.append(F.col(name).desc() if way == "desc" else F.col(name).asc())

    def _done(self, df: DataFrame) -> Frame:
        return Frame(df.orderBy(*self.order) if self.order else df)

    def agg(self, spec: Mapping[str, str | Sequence[str]]) -> Frame:
        return self._done(self.df.groupBy(*self.keys).agg(*aggregates(self.df, spec)))

    aggregate = agg

    def agg_sql(self, text: str) -> Frame:
        return self._done(self.df.groupBy(*self.keys).agg(*[F.expr(sql).alias(name) for sql, name in aliased(text)]))

    def count_distinct(self, column: str) -> Frame:
        return self._done(self.df.groupBy(*self.keys).agg(F.count_distinct(column).alias(column)))

    def cogroup(self, other: GroupedFrame, f: Callable, schema: str, required_left: Sequence[str] | None = None, required_right: Sequence[str] | None = None) -> Frame:
        if len(self.keys) != 1 or self.keys != other.keys:
            raise ValueError("both sides are grouped by one and the same key")
        return Frame(stateful.cogroup(self.df, other.df, f, schema, by=self.keys[0], left_columns=list(required_left) if required_left else None, right_columns=list(required_right) if required_right else None))

    def apply(self, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Frame:
        return Frame(stateful.run_per_key(self.df, f, schema, by=self.keys))


def _series(f: Callable, kind: str, df: DataFrame, required: list[str]) -> Column:
    """A function of a pandas frame as a vectorized column."""
    _need(df, required)

    @F.pandas_udf(kind)
    def made(*columns: pd.Series) -> pd.Series:
        return f(pd.DataFrame(dict(zip(required, columns))))

    return made(*[F.col(c) for c in required])


__all__ = ["Frame", "GroupedFrame", "OrderedFrame", "split_list"]


class IndexedVectors:
    """Rows with the cells of an index of their vectors."""

    def __init__(self, index: vectors.VectorIndex, rows: DataFrame, column: str) -> None:
        self.index, self.rows, self.column = index, rows, column

    def search(self, probe: Frame, k: int = 1, vec_column: str | None = None, suffix: str = "_probe") -> Frame:
        """The ``k`` rows nearest to every probe among the cells that its search looks into."""
        return Frame(vectors.vector_join(self.rows, probe.df, left=self.column, right=vec_column or self.column, k=k, suffix=suffix, index=self.index))
