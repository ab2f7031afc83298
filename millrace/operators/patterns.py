"""Event patterns over ordered streams.

A pattern is a list of events, each a name and an SQL predicate; a predicate may use the
row's own columns by name and the columns of earlier events as ``name.column``.  A match is
a row per event of one key, in strictly rising time, all within ``span`` of the first.

Every conjunct that needs no other event is applied to the table first, where the scan can
use it.  Events are joined one after the other on (key, bin of time): the first event looks
into the two bins that its span can touch and every other row lies in one, so no pair is
met twice and none outside the span's bins.
"""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.ticks import floor_div
from millrace.operators.timejoin import ordinal
from millrace.operators.windows import Size, units


def conjuncts(predicate: str) -> list[str]:
    """The parts of a predicate that AND joins at the top level (BETWEEN's AND is not one)."""
    tokens = re.split(r"(\(|\)|'(?:[^']|'')*'|\bAND\b|\bBETWEEN\b)", predicate, flags=re.IGNORECASE)
    parts, depth, between, now = [], 0, False, ""
    for tok in tokens:
        up = tok.upper()
        depth += (tok == "(") - (tok == ")")
        between |= up == "BETWEEN" and not depth
        if up == "AND" and not depth:
            if between:
                between = False
            else:
                parts.append(now.strip())
                now = ""
                continue
        now += tok
    return [p for p in [*parts, now.strip()] if p]


def match_pattern(df: DataFrame, *, time: str, by: str, events: Sequence[tuple[str, str]], span: Size, id: str, first_only: bool = True) -> DataFrame:
    """``by``, then ``<event>_<time>`` and ``<event>_<id>`` for each event.

    ``first_only``: of the matches of one starting row the one that completes first, ties by
    the earlier middle events, then ids; else all.  Rows with a null key or time never match;
    ``id`` tells rows apart and orders equal times.
    """
    names = [n for n, _ in events]
    if len(set(names)) != len(names) or len(names) < 2:
        raise ValueError("a pattern needs at least two events of different names")
    width = units(span)
    known = re.compile(r"\b(" + "|".join(map(re.escape, names)) + r")\.", re.IGNORECASE)
    alone, linked = [], []
    for k, (_, predicate) in enumerate(events):
        own = conjuncts(predicate)
        for c in own:
            for used in known.findall(c):
                if used.lower() not in [n.lower() for n in names[:k]]:
                    raise ValueError(f"{names[k]} may use earlier events only: {c}")
        alone.append([c for c in own if not known.search(c)])
        linked.append([c for c in own if known.search(c)])
    base = df.withColumn("__t", ordinal(df, time)).filter(F.col("__t").isNotNull() & F.col(by).isNotNull())

    def rows(k: int) -> DataFrame:
        return reduce(lambda d, c: d.filter(F.expr(c)), alone[k], base).select(F.struct(*df.columns, "__t").alias(names[k]))

    first = names[0]
    joined = rows(0)
    reach = F.sequence(floor_div(F.col(f"{first}.__t"), width), floor_div(F.col(f"{first}.__t") + width, width))
    joined = joined.withColumn("__bin", F.explode(reach))
    for k in range(1, len(names)):
        me, prev = names[k], names[k - 1]
        nxt = rows(k).withColumn("__own", floor_div(F.col(f"{me}.__t"), width)).withColumn("__key", F.col(f"{me}.{by}"))
        if k > 1:  # the next event may lie in another bin than the one before
            joined = joined.withColumn("__bin", F.explode(F.sequence(floor_div(F.col(f"{prev}.__t"), width), floor_div(F.col(f"{first}.__t") + width, width))))
        on = (F.col(f"{first}.{by}") == F.col("__key")) & (F.col("__bin") == F.col("__own"))
        on &= (F.col(f"{me}.__t") > F.col(f"{prev}.__t")) & (F.col(f"{me}.__t") <= F.col(f"{first}.__t") + width)
        joined = joined.join(nxt, on)
        for c in linked[k]:
            joined = joined.filter(F.expr(_qualified(c, me, names[:k], df.columns)))
        joined = joined.drop("__own", "__key", "__bin")
    out = joined
    if first_only:
        order = [F.col(f"{n}.__t") for n in [names[-1], *names[1:-1]]] + [F.col(f"{n}.{id}") for n in names[1:]]
        start = Window.partitionBy(f"{first}.{by}", f"{first}.{id}").orderBy(*order)
        out = out.withColumn("__rank", F.row_number().over(start)).filter("__rank = 1")
    return out.select(F.col(f"{first}.{by}").alias(by), *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in names for c in (time, id)])


def _qualified(predicate: str, me: str, earlier: list[str], columns: list[str]) -> str:
    """Own column names get the event's name; text in quotes and names of earlier events stay."""
    own = {c.lower() for c in columns}
    out = []
    for tok in re.split(r"('(?:[^']|'')*'|[A-Za-z_]\w*\s*\.\s*[A-Za-z_]\w*|[A-Za-z_]\w*)", predicate):
        if re.fullmatch(r"[A-Za-z_]\w*", tok) and tok.lower() in own and tok.lower() not in [e.lower() for e in earlier]:
            tok = f"{me}.{tok}"
        out.append(tok)
    return "".join(out)


def scan_pattern(df: DataFrame, *, time: str, by: str, events: Sequence[tuple[str, Callable[[dict, dict], bool]]], span: Size, id: str) -> DataFrame:
    """The first match of every starting row, with predicates in Python: ``f(row, earlier)`` where ``earlier`` maps event names to rows.

    Same result as ``match_pattern`` for predicates that SQL can't express.  A predicate's answer
    depends on its arguments only.  Keys are cut into spans of time, so a hot key is many tasks; a task
    goes through its keys and spans in order and holds the rows of one span and one batch, whatever the number of keys.
    """
    width = units(span)
    cut = df.withColumn("__t", ordinal(df, time)).filter(F.col("__t").isNotNull() & F.col(by).isNotNull())
    at = floor_div(F.col("__t"), width)
    cut = cut.withColumn("__home", at).withColumn("__part", F.explode(F.array(at, at - 1))).withColumn("__own", F.expr("__home = __part"))
    inside = Window.partitionBy(by, "__part").orderBy("__t", id)
    cut = cut.withColumn("__new", F.row_number().over(inside) == 1).select(*df.columns, "__t", "__own", "__new")
    schema = T.StructType([df.schema[by], *[T.StructField(f"{n}_{c}", df.schema[c].dataType) for n, _ in events for c in (time, id)]])
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    return cut.mapInArrow(_Scan(list(df.columns), time, by, id, list(events), width, zone), schema)


def _values(column: pa.Array, zone: str) -> list:
    """A column as predicates see it: null is NaN, NaT or None as in pandas, but whole numbers beside nulls stay whole."""
    if pa.types.is_integer(column.type) and column.null_count:
        return [math.nan if v is None else v for v in column.to_pylist()]
    got = column.to_pandas(date_as_object=True, maps_as_pydicts="strict")
    if pa.types.is_timestamp(column.type) and column.type.tz:
        got = got.dt.tz_convert(zone).dt.tz_localize(None)
    return got.tolist()


class _Asked(BaseException):
    """A predicate wants an earlier event."""


class _Unknown(Mapping):
    """Earlier events that aren't known yet: whoever looks at one is noted and stopped."""

    def __init__(self) -> None:
        self.asked = False

    def __getitem__(self, name: str) -> dict:
        self.asked = True
        raise _Asked

    def __iter__(self) -> Iterator:
        self.asked = True
        raise _Asked

    def __len__(self) -> int:
        self.asked = True
        raise _Asked


def ruled_out(ok: Callable[[dict, dict], bool], row: dict) -> bool:
    """Whether the predicate refuses the row without a look at earlier events, so for any of them."""
    past = _Unknown()
    try:
        return not ok(row, past) and not past.asked
    except (_Asked, Exception):  # an error is met again, if the row is ever reached
        return False


class _Scan:
    """Goes through rows in order of key, span and time, batch by batch."""

    def __init__(self, columns: list[str], time: str, by: str, id: str, events: list, width: int, zone: str) -> None:
        self.columns, self.time, self.by, self.id, self.width, self.zone = columns, time, by, id, width, zone
        self.names, self.steps = [n for n, _ in events], [ok for _, ok in events]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        rows: list[dict] = []
        own: list[bool] = []
        starts: list[int] = []  # rows that may start a match and weren't searched yet
        likely: list[list[int]] = [[] for _ in self.steps[1:]]  # rows that a later step doesn't rule out
        for batch in itertools.chain(batches, [None]):
            ends = []  # of the runs of one key and span that are over
            if batch is not None:
                if not batch.num_rows:
                    continue
                base, told = len(rows), pa.Table.from_batches([batch]).select(list(dict.fromkeys([self.by, self.time, self.id])))
                kept = told if kept is None else pa.concat_tables([kept, told])
                names = [*self.columns, "__t"]
                fresh = [dict(zip(names, v)) for v in zip(*[_values(batch.column(c), self.zone) for c in names])]
                rows += fresh
                own += batch.column("__own").to_pylist()
                for k, new in enumerate(batch.column("__new").to_pylist(), base):
                    if new and k:
                        ends.append(k)
                    if own[k] and self.steps[0](rows[k], {}):
                        starts.append(k)
                for step, ok in enumerate(self.steps[1:]):
                    likely[step] += [k for k, row in enumerate(fresh, base) if not ruled_out(ok, row)]
            elif not rows:
                return
            last, ends = len(rows), [*ends, len(rows)]
            found, done, run = [], 0, 0
            for k in starts:
                while ends[run] <= k:
                    run += 1
                if batch is not None and ends[run] == last and rows[k]["__t"] + self.width >= rows[-1]["__t"]:
                    break  # its span isn't over
                best = first_match(rows, k, self.steps[1:], self.names, self.width, ends[run], likely)
                if best:
                    found.append(best)
                done += 1
            if found:
                yield self.matches(kept, found)
            starts = starts[done:]
            # of what comes, a match can only start at a row that waits or isn't here yet
            gone = starts[0] if starts else last
            kept, rows, own = kept.slice(gone) if gone < last else None, rows[gone:], own[gone:]
            starts = [k - gone for k in starts]
            likely = [[k - gone for k in some[bisect_left(some, gone) :]] for some in likely]

    def matches(self, kept: pa.Table, found: list[list[int]]) -> pa.RecordBatch:
        names, columns = [self.by], [kept.column(self.by).take([m[0] for m in found])]
        for n, at in zip(self.names, zip(*found)):
            for c in (self.time, self.id):
                names.append(f"{n}_{c}")
                columns.append(kept.column(c).take(list(at)))
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in columns], names=names)


def first_match(
    rows: list[dict], start: int, steps: Sequence[Callable[[dict, dict], bool]], names: Sequence[str], width: int, end: int | None = None, likely: Sequence[list[int]] | None = None
) -> list[int] | None:
    """The rows of the match from ``start`` that completes first, ties by earlier middle times, then ids.

    Rows are in order of time and id, those of the key end before ``end``; ``likely`` lists, for each
    step, the rows that it may hold for (all, if not given).  Depth first, so only one path is held; a
    path that can't complete before the best one is given up.
    """
    limit = rows[start]["__t"] + width
    end = bisect_right(rows, limit, start, len(rows) if end is None else end, key=_when)
    among = likely or [range(end)] * len(steps)
    upto = [bisect_left(some, end) for some in among]
    if any(bisect_right(some, start) >= hi for some, hi in zip(among, upto)):
        return None
    best: tuple[list[int], list[int]] | None = None

    def go(path: list[int], past: dict) -> None:
        nonlocal best
        step = len(path) - 1
        last = step == len(steps) - 1
        some, ok, since = among[step], steps[step], rows[path[-1]]["__t"]
        middle = [rows[i]["__t"] for i in path[1:]]
        for at in range(bisect_right(some, path[-1]), upto[step]):
            j = some[at]
            t = rows[j]["__t"]
            # of paths that complete at one time, with middle events at the same times, the first has the least ids
            if best is not None and (t > best[0][0] or t == best[0][0] and (not last or middle >= best[0][1:])):
                break
            if t > since and ok(rows[j], past):
                if last:
                    best = [t, *middle], [*path, j]
                    break
                go([*path, j], {**past, names[step + 1]: rows[j]})

    go([start], {names[0]: rows[start]})
    return best and best[1]


def _when(row: dict) -> int:
    return row["__t"]
