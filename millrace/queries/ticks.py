"""Queries of the general tick problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.ticks import canonical_symbol, table, utc_day
from millrace.operators import rolling
from millrace.operators.spikes import flag_magnitudes, flag_readings
from millrace.operators.skew import value_frequencies, weighted_profile
from millrace.plans import durable

SYMBOL_SQL = r"nullif(regexp_replace(upper(symbol), '^\s+|\s*(\.CSV\.GZ)?\s*$', '', 'g'), '')"


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with one spelling of each symbol; redelivered rows count once."""
    return table(spark, sf_dir, "trades").select("trade_id", "time", canonical_symbol(F.col("symbol")).alias("symbol"), "size", "price").distinct()


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "quotes").select("seq", "time", canonical_symbol(F.col("symbol")).alias("symbol"), "bid", "ask", "bsize").distinct()


def _last(value: str, *order: str) -> F.Column:
    return F.max_by(value, F.struct(*order))


def p3_trades_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, totals, distinct prices, most frequent, median and 95th percentile price, last price."""
    trades = durable(_trades(spark, sf_dir))  # redelivered rows are found once, for both branches
    profile = weighted_profile(value_frequencies(trades, ["symbol"], "price"), ["symbol"], "price", percentiles=[0.5, 0.95])
    totals = trades.groupBy("symbol").agg(
        F.count("*").alias("trades"),
        F.sum("size").alias("total_size"),
        F.max(F.struct("time", "trade_id", "price")).getField("price").alias("last_price"),
    )
    return _beside(totals, profile, {"n_distinct": "prices", "mode": "usual_price", "p50": "median_price", "p95": "p95_price"})


def p3_quotes_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the quotes' bids, with the total size bid for."""
    quotes = durable(_quotes(spark, sf_dir))
    profile = weighted_profile(value_frequencies(quotes, ["symbol"], "bid"), ["symbol"], "bid", percentiles=[0.05, 0.5])
    totals = quotes.groupBy("symbol").agg(
        F.count("*").alias("quotes"),
        F.sum("bsize").alias("total_bsize"),
        F.max(F.struct("time", "seq", "ask")).getField("ask").alias("last_ask"),
    )
    return _beside(totals, profile, {"n_distinct": "bids", "mode": "usual_bid", "p5": "p5_bid", "p50": "median_bid"})


def _beside(totals: DataFrame, profile: DataFrame, names: dict[str, str]) -> DataFrame:
    p = profile.select(F.col("symbol").alias("symbol_p"), *[F.col(a).alias(b) for a, b in names.items()])
    return totals.join(p, F.col("symbol").eqNullSafe(F.col("symbol_p")), "left").drop("symbol_p")


def _profile_sql(source: str, value: str, totals: str, columns: str) -> str:
    return f"""
with s as ({source}),
f as (select symbol, {value} as v, count(*) as w from s where {value} is not null group by 1, 2),
m as (select symbol, v from (select *, row_number() over (partition by symbol order by w desc, v) as r from f) where r = 1),
t as (select symbol, {totals} from s group by symbol)
select t.*, m.v as {columns} from t left join m on t.symbol is not distinct from m.symbol
"""


PERIODS = (7, 30)
#: Days that p4_rolling adds to the kept state one by one.
NEW_DAYS = 3


def _daily(trades: DataFrame) -> DataFrame:
    return rolling.daily_amounts(trades, key="symbol", day=utc_day(F.col("time")), measures={"size": "size", "price": "price"})


def p4_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of size and average price over the last 7 and 30 days, for each symbol and day from first to last.

    The state of the history is built at once and kept; the last ``NEW_DAYS`` days arrive one
    after the other, each from the kept state of the day before.  Trades that came on a later
    day than their own are corrections: the days that one touches get a second version.
    """
    trades = table(spark, sf_dir, "trades").select("trade_id", "time", canonical_symbol(F.col("symbol")).alias("symbol"), "size", "price", F.unix_micros(F.col("recv_ts").cast("timestamp")).alias("recv"))
    # of redelivered rows the first to arrive counts
    trades = trades.groupBy("trade_id", "time", "symbol", "size", "price").agg(F.min("recv").alias("recv"))
    late = F.coalesce(utc_day(F.col("recv")) > utc_day(F.col("time")), F.lit(False))
    # one row per symbol, day and kind of arrival
    both = durable(_daily(trades.withColumn("symbol", F.struct("symbol", late.alias("late"))).filter("symbol.symbol is not null")))
    amounts = [c for c in both.columns if c not in ("key", "day")]
    on_time = F.col("key.late") == F.lit(False)
    # every key and both ends of the calendar must be there, also where all trades came late
    daily = both.groupBy(F.col("key.symbol").alias("key"), "day").agg(*[F.sum(F.when(on_time, F.col(c)).otherwise(F.lit(0).cast(both.schema[c].dataType))).cast(both.schema[c].dataType).alias(c) for c in amounts])
    daily = durable(daily)
    corrections = both.filter(~on_time).select(F.col("key.symbol").alias("key"), "day", *amounts)
    first, last = daily.agg(F.min("day"), F.max("day")).first()
    first, last = (0, -1) if first is None else (first, last)
    known = max(first, last - NEW_DAYS)
    state = durable(rolling.build_state(daily, PERIODS, first=first, last=known)) if last >= first else rolling.build_state(daily, PERIODS)
    state = rolling.advance(state, daily, PERIODS, range(known + 1, last + 1), version=0)
    state = rolling.latest(state.unionByName(rolling.correct_state(state, corrections, PERIODS, version=1)))
    return state.select(
        F.col("key").alias("symbol"),
        F.date_from_unix_date("day").alias("day"),
        *[F.col(f"size_sum_{n}").cast("long").alias(f"size_{n}d") for n in PERIODS],
        *[rolling.rolling_average("price", n).alias(f"avg_price_{n}d") for n in PERIODS],
        *[F.col(f"events_{n}").cast("long").alias(f"trades_{n}d") for n in PERIODS],
    )


_P4 = f"""
with t as (select distinct trade_id, time, {SYMBOL_SQL} as symbol, size, price from trades where {SYMBOL_SQL} is not null),
d as (select symbol, date '1970-01-01' + cast(floor(time / 86400000000.0) as int) as day, count(*) as n, sum(size) as size,
  sum(cast(case when not isnan(price) then price end as decimal(28, 6))) as price, count(price) as prices, count(*) filter (isnan(price)) as odd from t group by 1, 2),
c as (select symbol, cast(unnest(generate_series((select min(day) from d), (select max(day) from d), interval 1 day)) as date) as day from (select distinct symbol from d)),
x as (select c.symbol, c.day, coalesce(n, 0) as n, coalesce(size, 0) as size, coalesce(price, 0) as price, coalesce(prices, 0) as prices, coalesce(odd, 0) as odd
  from c left join d on c.symbol = d.symbol and c.day = d.day)
select symbol, day, {", ".join(f'''cast(sum(size) over w{n} as bigint) as size_{n}d, cast(sum(n) over w{n} as bigint) as trades_{n}d,
  case when sum(odd) over w{n} > 0 then 'nan'::double when sum(prices) over w{n} > 0 then cast(sum(price) over w{n} as double) / sum(prices) over w{n} end as avg_price_{n}d''' for n in PERIODS)}
from x window {", ".join(f"w{n} as (partition by symbol order by day rows {n - 1} preceding)" for n in PERIODS)}
"""

#: Fixed by the statement of problem 5.
SPIKE_CHANGES, SIZE_TIMES = 25.0, 40.0


def _flagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flagged readings, flagged sizes and impossible records of quotes and trades."""
    symbol = canonical_symbol(F.col("symbol")).alias("symbol")
    quotes = table(spark, sf_dir, "quotes").select("seq", "time", symbol, "bid", "ask")
    trades = table(spark, sf_dir, "trades").select("trade_id", "time", symbol, "price", "size")
    readings = flag_readings(
        quotes.select(F.lit("quotes").alias("src"), "symbol", "time", F.col("seq").alias("rec_id"), F.col("bid").alias("first"), F.col("ask").alias("second")).unionByName(
            trades.select(F.lit("trades").alias("src"), "symbol", "time", F.col("trade_id").alias("rec_id"), F.col("price").alias("first"), F.lit(None).cast("double").alias("second"))
        ),
        by=["src", "symbol"],
        kind="src",
        time="time",
        id="rec_id",
        values=["first", "second"],
        others={"first": "second", "second": "first"},
        stuck={"quotes": (20, 10), "trades": (15, 0)},
    )
    sizes = flag_magnitudes(trades.select("trade_id", "time", "symbol", "size").distinct(), by=["symbol"], time="time", id="trade_id", value="size")
    impossible = lambda c: (F.col(c) <= 0) | F.isnan(F.col(c))
    bad = quotes.filter(impossible("bid") | impossible("ask")).select(F.lit("quotes").alias("src"), F.col("seq").alias("rec_id"))
    bad = bad.unionByName(trades.filter(impossible("price") | (F.col("size") <= 0)).select(F.lit("trades").alias("src"), F.col("trade_id").alias("rec_id")))
    return readings, sizes, bad


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes and trades that are impossible, stuck or spikes.

    A spike is what the fitted cutoff of its source flags; the limits of the statement are
    then checked exactly on what is flagged.
    """
    readings, sizes, bad = _flagged(spark, sf_dir)
    found = readings.filter(F.col("stuck") | (F.col("spike") & (F.col("changes") > SPIKE_CHANGES))).select("src", "rec_id")
    large = sizes.filter(F.col("times") > SIZE_TIMES).select(F.lit("trades").alias("src"), F.col("trade_id").alias("rec_id"))
    return found.unionByName(large).unionByName(bad).distinct()


def p5_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fitted cutoffs alone flag, with the residual and the cutoff; no limit of the statement takes part."""
    readings, sizes, _ = _flagged(spark, sf_dir)
    field = F.when(F.col("src") == "trades", "price").when(F.col("field") == "first", "bid").otherwise("ask")
    spikes = readings.filter("spike").select("src", "rec_id", field.alias("field"), "changes", "residual", "cutoff")
    large = sizes.select(F.lit("trades").alias("src"), F.col("trade_id").alias("rec_id"), F.lit("size").alias("field"), F.col("times").alias("changes"), "residual", "cutoff")
    return spikes.unionByName(large)


QUERIES = {"p5_found": p5_found, "p5_flags": p5_flags, "p3_quotes_by_symbol": p3_quotes_by_symbol, "p3_trades_by_symbol": p3_trades_by_symbol, "p4_rolling": p4_rolling}
SQL = {
    "p3_trades_by_symbol": _profile_sql(
        f"select distinct trade_id, time, {SYMBOL_SQL} as symbol, size, price from trades",
        "price",
        "count(*) as trades, cast(sum(size) as bigint) as total_size, (max({'t': time, 'i': trade_id, 'v': price})).v as last_price, "
        "count(distinct price) as prices, quantile_cont(price, 0.5) as median_price, quantile_cont(price, 0.95) as p95_price",
        "usual_price",
    ),
    "p3_quotes_by_symbol": _profile_sql(
        f"select distinct seq, time, {SYMBOL_SQL} as symbol, bid, ask, bsize from quotes",
        "bid",
        "count(*) as quotes, cast(sum(bsize) as bigint) as total_bsize, (max({'t': time, 'i': seq, 'v': ask})).v as last_ask, "
        "count(distinct bid) as bids, quantile_cont(bid, 0.5) as median_bid, quantile_cont(bid, 0.05) as p5_bid",
        "usual_bid",
    ),
    "p4_rolling": _P4,
}
