"""Totals over trailing days, kept as a versioned daily state.

Method: the state of a key on a day holds its totals over each trailing period.  A day's
state is yesterday's totals, plus the day's arrivals, minus the amounts of the day that
leaves the period.  ``roll_forward`` takes the kept state of one day to the next, ``advance``
does so day after day; ``build_state`` runs the same recurrence over a whole history at once, as a running sum of
(arriving - expiring) amounts; ``correct_state`` recomputes only the days that a late or
corrected amount touches and gives them the next version.

Sums that are added to and subtracted from must be exact, or errors would stay in the state
for ever: integers are summed as integers, other numbers as decimals of ``scale`` places.
NaN, infinities and numbers too large for the decimal are counted beside the sum; while
one lies in the period its average is NaN.

Scale: events are reduced to one row per key and day with a partial aggregate before the
shuffle, so a hot key costs no more than its days; all later steps work on those rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans import durable

#: Digits of a single amount; a sum has ten more.
AMOUNT_DIGITS = 28


def daily_amounts(events: DataFrame, *, key: str, day: Column, measures: Mapping[str, str], scale: int = 6) -> DataFrame:
    """One row per key and day: ``key``, ``day`` (days since 1970), ``events`` and, for each measure, its sum, count and count of non-finite values.

    ``measures`` maps a name to a numeric column.  Null amounts count as events only; rows
    with a null key or day are left out.
    """
    amounts = {}
    for name, column in measures.items():
        if isinstance(events.schema[column].dataType, T.IntegralType):
            amounts[name] = F.col(column).cast("long")
        else:
            amounts[name] = F.col(column).cast("double").try_cast(f"decimal({AMOUNT_DIGITS},{scale})")
    narrow = events.select(F.col(key).alias("key"), day.cast("int").alias("day"), *[v.alias(f"v_{n}") for n, v in amounts.items()], *[F.col(c).isNotNull().alias(f"has_{n}") for n, c in measures.items()])
    aggs = [F.count(F.lit(1)).alias("events")]
    for n in measures:
        aggs += [
            F.coalesce(F.sum(f"v_{n}"), F.lit(0)).alias(f"{n}_sum"),
            F.count(f"v_{n}").alias(f"{n}_count"),
            F.count_if(F.col(f"has_{n}") & F.col(f"v_{n}").isNull()).alias(f"{n}_odd"),
        ]
    return narrow.dropna(subset=["key", "day"]).groupBy("key", "day").agg(*aggs)


def _amount_columns(daily: DataFrame) -> list[str]:
    return [c for c in daily.columns if c not in ("key", "day", "version")]


def build_state(daily: DataFrame, periods: Sequence[int], *, first: int | None = None, last: int | None = None, version: int = 0) -> DataFrame:
    """The state of every key on every day from ``first`` to ``last`` (by default those of ``daily``).

    Columns: ``key``, ``day``, ``<amount>_<period>`` and ``version``; days without activity included,
    and keys whose first day comes later.
    """
    amounts = _amount_columns(daily)
    if first is None or last is None:
        ends = daily.agg(F.min("day").alias("first"), F.max("day").alias("last"))
        days = daily.select("key").distinct().crossJoin(F.broadcast(ends)).select("key", F.explode(F.sequence("first", "last")).alias("day"))
    else:
        days = daily.select("key").distinct().select("key", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    of_key = Window.partitionBy("key").orderBy("day")
    dense = days.join(daily.drop("version"), ["key", "day"], "left").fillna(0, subset=amounts)
    dense = dense.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(daily.schema[c].dataType)) for c in amounts})
    flows = {}
    for n in periods:
        for c in amounts:
            # dense days: the amount that leaves the period is the one n rows back
            flows[f"{c}_{n}"] = F.col(c) - F.coalesce(F.lag(c, n).over(of_key), F.lit(0).cast(daily.schema[c].dataType))
    running = of_key.rowsBetween(Window.unboundedPreceding, 0)
    state = dense.select("key", "day", *[f.alias(n) for n, f in flows.items()])
    return state.select("key", "day", *[F.sum(n).over(running).cast(_wide(daily.schema[n.rpartition("_")[0]].dataType)).alias(n) for n in flows], F.lit(version).alias("version"))


def _wide(t: T.DataType) -> T.DataType:
    return T.DecimalType(38, t.scale) if isinstance(t, T.DecimalType) else T.LongType()


def roll_forward(state: DataFrame, daily: DataFrame, periods: Sequence[int], day: int, *, version: int) -> DataFrame:
    """The state of ``day``: that of ``day - 1``, joined with the day's arrivals and the expiring days' amounts.

    Keys seen for the first time start from zero.  ``state`` may hold several versions of
    yesterday; the latest counts.
    """
    amounts = _amount_columns(daily)
    wide = {f"{c}_{n}": _wide(daily.schema[c].dataType) for n in periods for c in amounts}

    def signed(of: int, sign: int, live: Sequence[int]) -> DataFrame:
        """The amounts of one day, as what they add to the totals of some periods."""
        cols = [((F.col(c) * sign) if n in live else F.lit(0)).cast(wide[f"{c}_{n}"]).alias(f"{c}_{n}") for n in periods for c in amounts]
        return daily.filter(F.col("day") == of).select("key", *cols)

    flows = latest(state.filter(F.col("day") == day - 1)).select("key", *[F.col(c).cast(t).alias(c) for c, t in wide.items()]).unionByName(signed(day, 1, periods))
    for n in periods:
        flows = flows.unionByName(signed(day - n, -1, [n]))
    totals = flows.groupBy("key").agg(*[F.sum(c).cast(t).alias(c) for c, t in wide.items()])
    return totals.select("key", F.lit(day).alias("day"), *wide, F.lit(version).alias("version"))


def advance(state: DataFrame, daily: DataFrame, periods: Sequence[int], days: Sequence[int], *, version: int) -> DataFrame:
    """``state`` with the given days added one after the other, each from the kept state of the day before."""
    out, kept = state, state
    for day in days:
        kept = durable(roll_forward(kept, daily, periods, day, version=version))
        out = out.unionByName(kept)
    return out


def correct_state(state: DataFrame, corrections: DataFrame, periods: Sequence[int], *, version: int) -> DataFrame:
    """State rows to add for ``corrections`` (daily amounts that came late, negative to take back).

    A correction of day d touches the days d .. d + period - 1 of its key and no others; the
    rows of those days get the corrections added and the new ``version``.  Days that
    ``state`` doesn't have are not created.
    """
    amounts = _amount_columns(corrections)
    longest = max(periods)
    touched = corrections.select("key", F.col("day").alias("of"), *[F.col(c).alias(f"c_{c}") for c in amounts], F.explode(F.sequence("day", F.col("day") + longest - 1)).alias("day"))
    sums = []
    for n in periods:
        live = F.col("day") - F.col("of") < n
        for c in amounts:
            sums.append(F.sum(F.when(live, F.col(f"c_{c}"))).alias(f"c_{c}_{n}"))
    added = touched.groupBy("key", "day").agg(*sums)
    rows = latest(state).join(added, ["key", "day"])
    cols = []
    for n in periods:
        for c in amounts:
            t = state.schema[f"{c}_{n}"].dataType
            cols.append((F.col(f"{c}_{n}") + F.coalesce(f"c_{c}_{n}", F.lit(0).cast(t))).cast(t).alias(f"{c}_{n}"))
    return rows.select("key", "day", *cols, F.lit(version).alias("version"))


def latest(state: DataFrame) -> DataFrame:
    """The highest version of each key and day."""
    w = Window.partitionBy("key", "day").orderBy(F.desc("version"))
    return state.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def rolling_average(name: str, period: int) -> Column:
    """Average of a measure over a period of the state: null without values, NaN while a non-finite one lies in it."""
    total, n, odd = F.col(f"{name}_sum_{period}"), F.col(f"{name}_count_{period}"), F.col(f"{name}_odd_{period}")
    return F.when(odd > 0, F.lit(float("nan"))).when(n > 0, total.cast("double") / n)
