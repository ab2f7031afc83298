"""Queries of the tick problems of this subpackage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.ticks import canonical_symbol, table, utc_day
from millrace.llm.nearest_time import nearest_time_join
from millrace.llm.run_collapse import collapse_runs

#: Fixed by the statement of the problem.
NEAREST_TOLERANCE = 2_000_000

SYMBOL_SQL = r"nullif(regexp_replace(upper(symbol), '^\s+|\s*(\.CSV\.GZ)?\s*$', '', 'g'), '')"


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = canonical_symbol(F.col("symbol"))
    trades = table(spark, sf_dir, "trades").select("trade_id", "time", symbol.alias("symbol")).distinct()
    quotes = table(spark, sf_dir, "quotes").filter("bid is not null").select("seq", "time", symbol.alias("symbol"), "bid")
    return nearest_time_join(trades, quotes, by="symbol", on="time", tolerance=NEAREST_TOLERANCE, tie=["seq"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest quote of every trade that has one within two seconds."""
    return _nearest(spark, sf_dir).select("trade_id", "seq")


def p1_nearest_bid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the quote's bid and the distance in time."""
    return _nearest(spark, sf_dir).select("trade_id", "symbol", "time", "bid", (F.col("time_2") - F.col("time")).alias("offset_us"))


_P1 = f"""
with t as (select distinct trade_id, time, {SYMBOL_SQL} as symbol from trades),
q as (select distinct seq, time, {SYMBOL_SQL} as symbol, bid from quotes where bid is not null),
m as (select t.trade_id, t.symbol, t.time, q.seq, q.bid, q.time - t.time as offset_us,
  row_number() over (partition by t.trade_id order by abs(q.time - t.time), q.time, q.seq) as r
  from t join q on t.symbol = q.symbol and q.time between t.time - {NEAREST_TOLERANCE} and t.time + {NEAREST_TOLERANCE})
"""


#: Fixed by the statement of the problem: most difference of each field, longest gap in microseconds.
RUN_LIMITS = {"bid": 0.005, "ask": 0.005, "bsize": 5, "asize": 5}
RUN_GAP = 600_000_000


def _runs(spark: SparkSession, sf_dir: str, min_count: int) -> DataFrame:
    quotes = table(spark, sf_dir, "quotes").withColumns({"symbol": canonical_symbol(F.col("symbol")), "day": utc_day(F.col("time"))})
    return collapse_runs(quotes, by=["symbol", "day"], time="time", id="seq", limits=RUN_LIMITS, max_gap=RUN_GAP, min_count=min_count)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last quote of every run of two or more quotes."""
    return _runs(spark, sf_dir, 2).select("first_seq", "last_seq")


def p2_runs_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of any length, totalled by symbol and day."""
    return (
        _runs(spark, sf_dir, 1)
        .groupBy("symbol", "day")
        .agg(F.count("*").alias("runs"), F.sum("n_events").alias("quotes"), F.max("n_events").alias("longest_run"), F.max("duration").alias("longest_us"))
    )


def _near(field: str, most: float) -> str:
    a, b = field, f"lag({field}) over w"
    nan = f" and not isnan({a}) and not isnan({b})" if field in ("bid", "ask") else ""
    return f"(({a} is null and {b} is null) or ({a} is not null and {b} is not null and abs({a} - {b}) <= {most}{nan}))"


_P2 = f"""
with q as (select distinct seq, time, {SYMBOL_SQL} as symbol, bid, ask, bsize, asize, cast(floor(time / 86400000000.0) as int) as day
  from quotes where {SYMBOL_SQL} is not null and time is not null and seq is not null),
s as (select *, case when time - lag(time) over w <= {RUN_GAP} and {" and ".join(_near(f, m) for f, m in RUN_LIMITS.items())} then 0 else 1 end as fresh
  from q window w as (partition by symbol, day order by time, seq)),
g as (select *, sum(fresh) over (partition by symbol, day order by time, seq rows unbounded preceding) as run from s),
r as (select symbol, day, run, arg_min(seq, (time, seq)) as first_seq, arg_max(seq, (time, seq)) as last_seq, count(*) as n_events, max(time) - min(time) as duration
  from g group by 1, 2, 3)
"""

QUERIES = {"p1_found": p1_found, "p1_nearest_bid": p1_nearest_bid, "p2_found": p2_found, "p2_runs_by_day": p2_runs_by_day}
SQL = {
    "p2_found": _P2 + "select first_seq, last_seq from r where n_events >= 2",
    "p2_runs_by_day": _P2
    + "select symbol, day, count(*) as runs, cast(sum(n_events) as bigint) as quotes, max(n_events) as longest_run, max(duration) as longest_us from r group by 1, 2",
    "p1_found": _P1 + "select trade_id, seq from m where r = 1",
    "p1_nearest_bid": _P1 + "select trade_id, symbol, time, bid, offset_us from m where r = 1",
}
