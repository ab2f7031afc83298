"""As-of and range joins, windows, shift, bars and indicators on the ordered tables."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import functions as F

from millrace.frame import Frame
from millrace.functions.ticks import canonical_symbol
from millrace.operators.windows import Hopping, OnCompletion, OnEvent, Session, Sliding, Tumbling
from millrace.queries.base import Family, Tables

family = Family()
add = family.add
QUERIES, SQL = family.queries, family.sql
HOUR, DAY = timedelta(hours=1), timedelta(days=1)


def _asof(t: Tables, **how) -> Frame:
    right = t.events_of("view").select(["user_id", "ts", "value", "event_id"]).rename({"event_id": "seen_id"})
    got = t.events_of("purchase").select(["event_id", "user_id", "ts", "value"]).join_asof(right, by="user_id", suffix="_seen", tie=["seen_id"], span=7 * DAY, **how)
    return got.select(["event_id", "user_id", "value", "value_seen", "seen_id"])


_PV = "with p as (select * from events where event_type = 'purchase'), v as (select * from events where event_type = 'view') "


@add(_PV + "select p.event_id, p.user_id, p.value, v.value as value_seen, v.event_id as seen_id from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts")
def asof_backward(t: Tables) -> Frame:
    return _asof(t)


@add(_PV + "select p.event_id, p.user_id, p.value, v.value as value_seen, v.event_id as seen_id from p asof left join v on p.user_id = v.user_id and p.ts <= v.ts")
def asof_forward(t: Tables) -> Frame:
    return _asof(t, direction="forward")


@add(
    _PV
    + """select p.event_id, p.user_id, p.value, case when p.ts - v.ts <= interval 1 day then v.value end as value_seen, case when p.ts - v.ts <= interval 1 day then v.event_id end as seen_id
from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts"""
)
def asof_tolerance(t: Tables) -> Frame:
    return _asof(t, tolerance=DAY)


_TICKS = r"""with q as (select distinct seq, time, symbol, bid from quotes where symbol is not null and bid is not null and not isnan(bid)), t as (select distinct trade_id, time, nullif(regexp_replace(upper(symbol), '^\s+|\s*(\.CSV\.GZ)?\s*$', '', 'g'), '') as symbol, size from trades where size is not null),
j as (select t.symbol, t.trade_id, t.size, arg_max(q.bid, (q.time, q.seq)) as bid from t left join (select *, time // 60000000 as b from q) q on t.symbol = q.symbol and q.time <= t.time and q.time > t.time - 60000000 and q.b in (t.time // 60000000, t.time // 60000000 - 1) group by 1, 2, 3) """


@add(_TICKS + "select symbol, cast(sum(size) as bigint) as traded, count(bid) as quoted, round(avg(bid), 6) as avg_bid from j where symbol is not null group by 1")
def asof_ticks(t: Tables) -> Frame:
    """Each trade with the latest bid of its symbol within the last minute, totalled by symbol."""
    symbol = canonical_symbol(F.col("symbol")).alias("symbol")
    quotes = t.quotes.filter_sql("bid is not null and not isnan(bid)").df.select("seq", "time", symbol, "bid").distinct()
    trades = t.trades.filter_sql("size is not null").df.select("trade_id", "time", symbol, "size").distinct()
    # "within the last minute" leaves the far end out: one microsecond less
    got = Frame(trades).ordered_by("time").join_asof(Frame(quotes).ordered_by("time"), by="symbol", tolerance=60_000_000 - 1, tie=["seq"], span=3_600_000_000)
    return got.filter_sql("symbol is not null").groupby("symbol").agg_sql("sum(size) as traded, count(bid) as quoted, round(avg(bid), 6) as avg_bid")


@add("""select c.event_id as event_id, p.event_id as event_id_2, c.user_id as user_id from (select * from events where event_type = 'purchase') c join (select * from events where event_type = 'click') p
on c.user_id = p.user_id and p.ts >= c.ts - interval 6 hour and p.ts <= c.ts""")
def range_join(t: Tables) -> Frame:
    return t.events_of("purchase").join_range(t.events_of("click"), by="user_id", before=6 * HOUR).select(["event_id", "event_id_2", "user_id"])


@add("""select time_bucket(interval 6 hour, ts, timestamp '1970-01-01') as ts, user_id, round(sum(value), 4) as total, count(*) as n, max(value) as top from events group by 1, 2""")
def win_tumbling(t: Tables) -> Frame:
    spec = Tumbling("ts", "user_id", {"total": "round(sum(value), 4)", "n": "count(*)", "top": "max(value)"}, size=6 * HOUR)
    return t.events.ordered_by("ts").windowed_transform(spec, OnCompletion())


@add("""select s as ts, user_id, round(sum(value), 4) as total, round(avg(value), 6) as mean, count(*) as n
from (select user_id, value, unnest([time_bucket(interval 3 hour, ts, timestamp '1970-01-01') - i * interval 3 hour for i in [0, 1, 2, 3]]) as s from events) group by 1, 2""")
def win_hopping(t: Tables) -> Frame:
    spec = Hopping("ts", "user_id", {"total": "round(sum(value), 4)", "mean": "round(avg(value), 6)", "n": "count(*)"}, hop=3 * HOUR, size=12 * HOUR)
    return t.events.ordered_by("ts").windowed_transform(spec, OnCompletion())


@add("""select s as event_id, user_id, count(*) as n, round(sum(value), 4) as total from (select user_id, event_id, value, unnest([(event_id // 10 - i) * 10 for i in [0, 1, 2]]) as s from events)
where s + 25 > event_id group by 1, 2""")
def win_hopping_int(t: Tables) -> Frame:
    spec = Hopping("event_id", "user_id", {"n": "count(*)", "total": "round(sum(value), 4)"}, hop=10, size=25)
    return t.events.ordered_by("event_id").windowed_transform(spec, OnCompletion())


@add("""select ts, user_id, round(sum(value) over w, 4) as total, count(*) over w as n, max(value) over w as top from events
window w as (partition by user_id order by epoch_us(ts) range between 86399999999 preceding and current row)""")
def win_sliding(t: Tables) -> Frame:
    spec = Sliding("ts", "user_id", {"total": "sum(value)", "n": "count(*)", "top": "max(value)"}, size_before=DAY)
    got = t.events.ordered_by("ts").windowed_transform(spec, OnEvent())
    return Frame(got.df.withColumn("total", F.round("total", 4)))


@add("""select ts, user_id, count(*) over w as n, round(avg(value) over w, 6) as mean from events
window w as (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row)""")
def win_sliding_closed(t: Tables) -> Frame:
    spec = Sliding("ts", "user_id", {"n": "count(*)", "mean": "avg(value)"}, size_before=DAY, closed="both")
    got = t.events.ordered_by("ts").windowed_transform(spec, OnEvent())
    return Frame(got.df.withColumn("mean", F.round("mean", 6)))


_SESSIONS = """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 2 hour then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from g) """


@add(_SESSIONS + "select min(ts) as ts, user_id, count(*) as n, round(sum(value), 4) as total from s group by user_id, session")
def win_session(t: Tables) -> Frame:
    spec = Session("ts", "user_id", {"n": "count(*)", "total": "round(sum(value), 4)"}, timeout=2 * HOUR)
    return t.events.ordered_by("ts").windowed_transform(spec, OnCompletion())


@add(_SESSIONS + "select ts, user_id, count(*) over w as n, max(value) over w as top from s window w as (partition by user_id, session order by ts range between unbounded preceding and current row)")
def win_session_event(t: Tables) -> Frame:
    spec = Session("ts", "user_id", {"n": "count(*)", "top": "max(value)"}, timeout=2 * HOUR)
    return t.events.ordered_by("ts").windowed_transform(spec, OnEvent())


@add("""select ts, user_id, count(*) over w as n, max(value) over w as top from events
window w as (partition by user_id, time_bucket(interval 1 day, ts, timestamp '1970-01-01') order by ts range between unbounded preceding and current row)""")
def win_tumbling_event(t: Tables) -> Frame:
    spec = Tumbling("ts", "user_id", {"n": "count(*)", "top": "max(value)"}, size=DAY)
    return t.events.ordered_by("ts").windowed_transform(spec, OnEvent())


@add("select event_id, user_id, coalesce(lag(value, 2) over (partition by user_id order by ts), -1) as value_shifted from events")
def shift_lag(t: Tables) -> Frame:
    return t.events.ordered_by("ts").shift("value", 2, by="user_id", fill_value=-1.0).select(["event_id", "user_id", "value_shifted"])


@add("select event_id, user_id, lead(value, 1) over (partition by user_id order by ts) as value_shifted from events")
def shift_lead(t: Tables) -> Frame:
    return t.events.ordered_by("ts").shift("value", -1, by="user_id").select(["event_id", "user_id", "value_shifted"])


_PRICES = r"""(select distinct trade_id, time, nullif(regexp_replace(upper(symbol), '^\s+|\s*(\.CSV\.GZ)?\s*$', '', 'g'), '') as symbol, price, size from trades where price > 0 and not isnan(price) and size > 0)"""


def _prices(t: Tables) -> Frame:
    df = t.trades.filter_sql("price > 0 and not isnan(price) and size > 0").df
    return Frame(df.select("trade_id", "time", canonical_symbol(F.col("symbol")).alias("symbol"), "price", "size").distinct().filter("symbol is not null"))


@add(f"""select symbol, time // 86400000000 * 86400000000 as time, arg_min(price, (time, trade_id)) as open, arg_max(price, (time, trade_id)) as close, max(price) as high, min(price) as low,
cast(sum(size) as bigint) as volume from {_PRICES} where symbol is not null group by 1, 2""")
def ohlc(t: Tables) -> Frame:
    """Bars of a day: the first, last, highest and lowest price and the volume."""
    aggs = {"open": "min_by(price, struct(time, trade_id))", "close": "max_by(price, struct(time, trade_id))", "high": "max(price)", "low": "min(price)", "volume": "sum(size)"}
    return _prices(t).ordered_by("time").windowed_transform(Tumbling("time", "symbol", aggs, size=86_400_000_000), OnCompletion())


@add(f"""with d as (select symbol, time // 86400000000 as day, arg_max(price, (time, trade_id)) as close from {_PRICES} where symbol is not null group by 1, 2)
select symbol, day, round(avg(close) over w, 6) as sma, round(avg(close) over w + 2 * stddev_pop(close) over w, 5) as upper, round(avg(close) over w - 2 * stddev_pop(close) over w, 5) as lower
from d window w as (partition by symbol order by day range between 19 preceding and current row)""")
def sma_bollinger(t: Tables) -> Frame:
    """Moving average of daily closes over 20 days with bands of two deviations."""
    aggs = {"close": "max_by(price, struct(time, trade_id))"}
    daily = _prices(t).ordered_by("time").windowed_transform(Tumbling("time", "symbol", aggs, size=86_400_000_000), OnCompletion())
    daily = daily.with_columns_sql("cast(time div 86400000000 as bigint) as day").select(["symbol", "day", "close"])
    got = daily.ordered_by("day").windowed_transform(Sliding("day", "symbol", {"mean": "avg(close)", "dev": "stddev_pop(close)"}, size_before=20), OnEvent())
    return got.with_columns_sql("round(mean, 6) as sma, round(mean + 2 * dev, 5) as upper, round(mean - 2 * dev, 5) as lower").select(["symbol", "day", "sma", "upper", "lower"])


@add(f"""with d as (select symbol, time // 86400000000 as day, arg_max(price, (time, trade_id)) as close from {_PRICES} where symbol is not null group by 1, 2),
c as (select *, close - lag(close) over w as change from d window w as (partition by symbol order by day))
select symbol, day, round(100 * avg(greatest(change, 0)) over w / nullif(avg(abs(change)) over w, 0), 5) as rsi from c window w as (partition by symbol order by day rows 13 preceding)""")
def rsi(t: Tables) -> Frame:
    """Relative strength over the last 14 daily changes."""
    aggs = {"close": "max_by(price, struct(time, trade_id))"}
    daily = _prices(t).ordered_by("time").windowed_transform(Tumbling("time", "symbol", aggs, size=86_400_000_000), OnCompletion())
    daily = daily.with_columns_sql("cast(time div 86400000000 as bigint) as day").select(["symbol", "day", "close"]).ordered_by("day").shift("close", 1, by="symbol")
    return t.engine.sql(
        "select symbol, day, round(100 * avg(greatest(change, 0)) over w / nullif(avg(abs(change)) over w, 0), 5) as rsi from (select *, if(close_shifted is null, null, close - close_shifted) as change from {d}) "
        "window w as (partition by symbol order by day rows 13 preceding)",
        d=daily,
    )


@add(f"""with recursive d as (select symbol, time, close, row_number() over (partition by symbol order by time) as k
  from (select symbol, time // 86400000000 * 86400000000 as time, arg_max(price, (time, trade_id)) as close from {_PRICES} where symbol is not null group by 1, 2)),
e as (select symbol, time, k, close as fast, close as slow from d where k = 1
  union all select d.symbol, d.time, d.k, e.fast * (1 - 2.0::double / 13) + d.close * (2.0::double / 13), e.slow * (1 - 2.0::double / 27) + d.close * (2.0::double / 27) from e join d on d.symbol = e.symbol and d.k = e.k + 1)
select symbol, time, round(fast, 6) as ema_12, round(slow, 6) as ema_26, round(fast - slow, 6) as macd from e""")
def ema_macd(t: Tables) -> Frame:
    """Exponential averages of daily closes over 12 and 26 days and their difference; a day's value builds on the day before.

    Python sees one row per symbol and day.
    """

    def averages(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time", ignore_index=True)
        fast, slow = (pdf["close"].ewm(span=n, adjust=False).mean() for n in (12, 26))
        return pdf[["symbol", "time"]].assign(ema_12=fast.round(6), ema_26=slow.round(6), macd=(fast - slow).round(6))

    aggs = {"close": "max_by(price, struct(time, trade_id))"}
    daily = _prices(t).ordered_by("time").windowed_transform(Tumbling("time", "symbol", aggs, size=86_400_000_000), OnCompletion())
    return daily.groupby("symbol").apply(averages, "symbol string, time long, ema_12 double, ema_26 double, macd double")
