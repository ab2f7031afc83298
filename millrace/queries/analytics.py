"""Quantiles, matrices, vectors, patterns and operators in Python."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import functions as F

from millrace.frame import Frame
from millrace.functions.ticks import canonical_symbol
from millrace.operators.patterns import scan_pattern
from millrace.operators.stateful import Executor
from millrace.queries.base import Family, Tables

family = Family()
add = family.add
QUERIES, SQL = family.queries, family.sql
DAY = timedelta(days=1)


@add("""select q as quantile, case q when 0.1 then a[1] when 0.5 then a[2] else a[3] end as l_quantity, round(case q when 0.1 then b[1] when 0.5 then b[2] else b[3] end, 6) as l_extendedprice
from (select quantile_cont(l_quantity, [0.1, 0.5, 0.9]) as a, quantile_cont(l_extendedprice, [0.1, 0.5, 0.9]) as b from lineitem), (select unnest([0.1::double, 0.5::double, 0.9::double]) as q)""")
def quantile_exact(t: Tables) -> Frame:
    got = t.lineitem.quantile(["l_quantity", "l_extendedprice"], [0.1, 0.5, 0.9])
    return Frame(got.df.withColumn("l_extendedprice", F.round("l_extendedprice", 6)))


@add()
def quantile_approximate(t: Tables) -> Frame:
    return t.lineitem.approximate_quantile(["l_quantity", "l_extendedprice"], [0.1, 0.5, 0.9])


@add()
def median_approximate(t: Tables) -> Frame:
    return t.lineitem.approximate_median("l_extendedprice")


_MATRIX = ("l_quantity", "price_k", "l_discount", "l_tax")
_LINES = "(select *, l_extendedprice / 1000 as price_k from lineitem)"


def _matrix_sql(cell: str) -> str:
    return " union all ".join(f"select '{a}' as \"column\", " + ", ".join(f"round({cell.format(a=a, b=b)}, 3) as {b}" for b in _MATRIX) + f" from {_LINES}" for a in _MATRIX)


def _rounded(f: Frame) -> Frame:
    return Frame(f.df.select("column", *[F.round(c, 3).alias(c) for c in _MATRIX]))


@add(_matrix_sql("sum({a} * {b})"))
def gramian(t: Tables) -> Frame:
    return _rounded(t.lineitem.with_columns_sql("l_extendedprice / 1000 as price_k").gramian(_MATRIX))


@add(_matrix_sql("covar_pop({a}, {b})"))
def covariance(t: Tables) -> Frame:
    return _rounded(t.lineitem.with_columns_sql("l_extendedprice / 1000 as price_k").covariance(_MATRIX))


#: Columns of the wide matrix: remainders of keys at so many divisors.
_WIDE = 200


@add(f"""with x as (select l_orderkey, l_partkey, l_linenumber from lineitem), j as (select unnest(range({_WIDE})) as j)
select 'c' || j as "column", sum((l_orderkey % (j + 3)) * (l_partkey % 5))::double as c2, sum((l_orderkey % (j + 3)) * (l_orderkey % 3))::double as c0, sum((l_orderkey % (j + 3)) * (l_orderkey % {_WIDE + 2}))::double as c_last
from x, j where j <> 2 group by j union all
select 'c2', sum((l_partkey % 5) * (l_partkey % 5))::double, sum((l_partkey % 5) * (l_orderkey % 3))::double, sum((l_partkey % 5) * (l_orderkey % {_WIDE + 2}))::double from x""")
def gramian_wide(t: Tables) -> Frame:
    """The matrix of 200 columns by column blocks; three of its columns are shown."""
    columns = [f"c{j}" for j in range(_WIDE)]
    x = t.lineitem.df.select(*[(F.pmod("l_partkey", F.lit(5)) if j == 2 else F.pmod("l_orderkey", F.lit(j + 3))).alias(c) for j, c in enumerate(columns)])
    return Frame(Frame(x).gramian(columns).df.select("column", "c2", "c0", F.col(columns[-1]).alias("c_last")))


_SIM = "list_cosine_similarity(cast(e.embedding as double[]), cast(p.embedding as double[]))"


_RANK = f"row_number() over (partition by p.vec_id order by {_SIM} desc, e.vec_id)"
_ASKED = "from embeddings e, embeddings p where p.vec_id % 50 = 0"


def _probes(t: Tables) -> Frame:
    """The searches: every fiftieth row against all rows, so they grow with the table."""
    return t.embeddings.filter_sql("vec_id % 50 = 0").rename({"vec_id": "probe"}).select(["probe", "embedding"])


@add(f"select vec_id, probe, rank, similarity from (select e.vec_id, p.vec_id as probe, {_RANK} as rank, round({_SIM}, 6) as similarity {_ASKED}) where rank <= 5")
def vector_knn(t: Tables) -> Frame:
    got = t.embeddings.select(["vec_id", "embedding"]).vector_nn_join(_probes(t), "embedding", k=5)
    return Frame(got.df.select("vec_id", "probe", "rank", F.round("similarity", 6).alias("similarity")))


@add(f"select vec_id, probe, rank from (select e.vec_id, p.vec_id as probe, {_RANK} as rank {_ASKED} and e.label = 3) where rank <= 3")
def vector_knn_filtered(t: Tables) -> Frame:
    """A filter before the search: the nearest among those left."""
    got = t.embeddings.filter_sql("label = 3").select(["vec_id", "embedding"]).vector_nn_join(_probes(t), "embedding", k=3)
    return got.select(["vec_id", "probe", "rank"])


@add(f"select probe as vec_id, vec_id as nearest from (select e.vec_id, p.vec_id as probe, {_RANK} as rank {_ASKED} and e.vec_id <> p.vec_id) where rank = 1")
def vector_knn_left(t: Tables) -> Frame:
    """The nearest other row of the whole table: of the two nearest, the first that isn't the row itself."""
    other = t.embeddings.rename({"vec_id": "nearest"}).select(["nearest", "embedding"])
    got = _probes(t).vector_nn_join(other, "embedding", k=2, probe_side="left").filter_sql("probe <> nearest")
    return got.groupby("probe").agg_sql("min_by(nearest, rank) as nearest").rename({"probe": "vec_id"})


@add(f"select e.vec_id, p.vec_id as probe {_ASKED} and e.vec_id <> p.vec_id and {_SIM} >= 0.3")
def vector_range(t: Tables) -> Frame:
    got = t.embeddings.select(["vec_id", "embedding"]).vector_range_join(_probes(t), "embedding", 0.3)
    return got.filter_sql("vec_id <> probe").select(["vec_id", "probe"])


@add()
def vector_ann(t: Tables) -> Frame:
    """The same searches through an index that every row is in."""
    return t.embeddings.select(["vec_id", "embedding"]).vector_index("embedding").search(_probes(t), k=5).select(["vec_id", "probe", "rank"])


@add("select count(*) as searches, true as recall_held from embeddings where vec_id % 50 = 0")
def vector_ann_recall(t: Tables) -> Frame:
    """Whether the index finds nine in ten of what the exact search finds."""
    exact, found = vector_knn(t).df.select("probe", "vec_id"), vector_ann(t).df.select("probe", "vec_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["probe", "vec_id"], "left")
    return Frame(both.agg(F.count_distinct("probe").alias("searches"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("recall_held")))


_STEPS = [("a", "event_type = 'view'"), ("b", "event_type = 'click' and value > a.value"), ("c", "event_type = 'purchase' and value < b.value")]
_CEP = """with m as (select a.user_id, a.ts as a_ts, a.event_id as a_event_id, b.ts as b_ts, b.event_id as b_event_id, c.ts as c_ts, c.event_id as c_event_id,
row_number() over (partition by a.event_id order by c.ts, b.ts, b.event_id, c.event_id) as r from events a join events b on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval 1 day and b.value > a.value
join events c on a.user_id = c.user_id and c.ts > b.ts and c.ts <= a.ts + interval 1 day and c.value < b.value
where a.event_type = 'view' and b.event_type = 'click' and c.event_type = 'purchase') select * exclude (r) from m"""


@add(_CEP + " where r = 1")
def cep_first_match(t: Tables) -> Frame:
    return t.events.ordered_by("ts").pattern_recognize(_STEPS, DAY, by="user_id", id="event_id")


@add(_CEP)
def cep_all(t: Tables) -> Frame:
    return t.events.ordered_by("ts").pattern_recognize(_STEPS, DAY, by="user_id", id="event_id", all_matches=True)


@add(_CEP + " where r = 1")
def cep_scan(t: Tables) -> Frame:
    """The same pattern with predicates in Python."""
    steps = [
        ("a", lambda row, _: row["event_type"] == "view"),
        ("b", lambda row, past: row["event_type"] == "click" and row["value"] > past["a"]["value"]),
        ("c", lambda row, past: row["event_type"] == "purchase" and row["value"] < past["b"]["value"]),
    ]
    narrow = t.events.select(["user_id", "ts", "event_id", "event_type", "value"]).df
    return Frame(scan_pattern(narrow, time="ts", by="user_id", events=steps, span=DAY, id="event_id"))


class RunningBest(Executor):
    """The highest value of each user so far, told when it rises."""

    def __init__(self) -> None:
        self.best: dict[int, float] = {}

    def execute(self, batch: pd.DataFrame, stream: int) -> pd.DataFrame:
        rows = []
        for user, event, value in zip(batch["user_id"], batch["event_id"], batch["value"]):
            if value > self.best.get(user, float("-inf")):
                self.best[user] = value
                rows.append((user, event, value))
        return pd.DataFrame(rows, columns=["user_id", "event_id", "best"])


@add("""select user_id, event_id, value as best from (select *, max(value) over (partition by user_id order by ts rows between unbounded preceding and 1 preceding) as before from events)
where before is null or value > before""")
def stateful_transform(t: Tables) -> Frame:
    return t.events.ordered_by("ts").stateful_transform(RunningBest, "user_id long, event_id long, best double", required=["event_id", "value"], by="user_id")


@add("""with p as (select * from events where event_type = 'purchase'), v as (select * from events where event_type = 'view')
select p.event_id, p.user_id, v.event_id as seen_id from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts""")
def cogroup_asof(t: Tables) -> Frame:
    """An as-of join by key in Python, as a user would write it."""

    def join(p: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        v = v.rename(columns={"event_id": "seen_id"})[["ts", "seen_id"]].sort_values("ts")
        out = pd.merge_asof(p.sort_values("ts"), v, on="ts")
        return out[["event_id", "user_id", "seen_id"]].astype({"seen_id": "Int64"})

    columns = ["user_id", "ts", "event_id"]
    left, right = t.events.filter_sql("event_type = 'purchase'").groupby("user_id"), t.events.filter_sql("event_type = 'view'").groupby("user_id")
    return left.cogroup(right, join, "event_id long, user_id long, seen_id long", columns, columns)


class Tally(Executor):
    def __init__(self) -> None:
        self.seen: dict[int, int] = {}

    def execute(self, batch: pd.DataFrame, stream: int) -> None:
        self.seen[stream] = self.seen.get(stream, 0) + len(batch)

    def done(self) -> pd.DataFrame:
        return pd.DataFrame({"stream": list(self.seen), "n": list(self.seen.values())}, dtype="int64")


@add("select 0 as stream, count(*) as n from orders union all select 1 as stream, count(*) as n from customer")
def mingle_sources(t: Tables) -> Frame:
    got = t.engine.mingle([t.orders.select(["o_orderkey"]), t.customer.select(["c_custkey"])], Tally, "stream long, n long")
    return got.groupby("stream").agg_sql("sum(n) as n")


_SYMBOL = r"nullif(regexp_replace(upper(symbol), '^\s+|\s*(\.CSV\.GZ)?\s*$', '', 'g'), '')"


@add(f"""with t as (select distinct trade_id, time, {_SYMBOL} as symbol, price from trades where price > 0 and not isnan(price) and {_SYMBOL} is not null),
s as (select symbol, time, max(direction) as direction from (select epoch_us(ts) as time, {_SYMBOL} as symbol, direction from alphas where direction is not null and ts is not null) where symbol is not null group by 1, 2),
b as (select t.*, coalesce(s.direction, 0)::double as position from t asof left join s on t.symbol = s.symbol and t.time >= s.time where t.symbol in (select symbol from s)),
p as (select *, coalesce(lag(position) over w, 0) * coalesce(price - lag(price) over w, 0) as gain from b window w as (partition by symbol order by time, trade_id))
select symbol, time // 86400000000 as day, round(sum(gain), 4) as profit, arg_max(position, (time, trade_id)) as position, count(*) as trades from p group by 1, 2""")
def backtest(t: Tables) -> Frame:
    """Daily profit of the alpha signals on the trades, by symbol: one unit long or short from each signal's next price until the opposite signal.

    An as-of join finds the signal that holds at a trade, a shift the position before it; both cut hot symbols by time.
    """
    symbol = canonical_symbol(F.col("symbol")).alias("symbol")
    trades = t.trades.filter_sql("price > 0 and not isnan(price)").df.select("trade_id", "time", symbol, "price").distinct().filter("symbol is not null")
    signals = t.alphas.filter_sql("direction is not null and ts is not null").df
    signals = signals.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), symbol, "direction").filter("symbol is not null")
    # of signals at one time the long one holds
    signals = signals.groupBy("symbol", "time").agg(F.max("direction").alias("direction"))
    traded = trades.join(signals.select("symbol").distinct(), "symbol", "semi")
    held = Frame(traded).ordered_by("time").join_asof(Frame(signals).ordered_by("time"), by="symbol").with_columns_sql("cast(coalesce(direction, 0) as double) as position")
    moved = held.select(["symbol", "time", "trade_id", "price", "position"]).ordered_by("time").shift(["position", "price"], 1, by="symbol", tie=["trade_id"])
    gain = "coalesce(position_shifted, 0) * coalesce(price - price_shifted, 0)"
    days = moved.with_columns_sql("time div 86400000000 as day").groupby(["symbol", "day"])
    return days.agg_sql(f"round(sum({gain}), 4) as profit, max_by(position, struct(time, trade_id)) as position, count(*) as trades")


@add("select event_type, count(*) as n, max(value) as top from events group by 1")
def apply_per_key(t: Tables) -> Frame:
    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_type": [pdf["event_type"].iloc[0]], "n": [len(pdf)], "top": [pdf["value"].max()]})

    return t.events.select(["event_type", "value"]).groupby("event_type").apply(summary, "event_type string, n long, top double")
