"""Sources, sinks and streams: each query writes what it reads again into the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.frame import Frame
from millrace.plans import shared_dir
from millrace.queries.base import Family, Tables
from millrace.streaming import jobs

family = Family()
add = family.add
QUERIES, SQL = family.queries, family.sql


def _place(t: Tables, stem: str) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


@add("select s_suppkey, s_name, s_nationkey from supplier")
def csv_round_trip(t: Tables) -> Frame:
    place = _place(t, "csv")
    t.supplier.select(["s_suppkey", "s_name", "s_nationkey"]).write_csv(place, output_line_limit=1000)
    return t.engine.read_csv(place, has_header=True).select(["s_suppkey", "s_name", "s_nationkey"])


@add("select c_custkey, c_name, c_acctbal from customer")
def csv_by_names(t: Tables) -> Frame:
    """A separator of its own, names given, a last empty field as generated benchmark files have."""
    place = _place(t, "csv")
    t.customer.df.select("c_custkey", "c_name", "c_acctbal", F.lit(None).cast("string").alias("none")).write.option("sep", "|").option("header", False).csv(place)
    return t.engine.read_csv(place, schema=["c_custkey", "c_name", "c_acctbal"], sep="|")


@add("select o_orderkey, o_custkey, o_totalprice from orders")
def parquet_round_trip(t: Tables) -> Frame:
    place = _place(t, "parquet")
    t.orders.select(["o_orderkey", "o_custkey", "o_totalprice"]).write_parquet(place, output_line_limit=4000)
    return t.engine.read_parquet(place)


@add("select 'lineitem' as file, count(*) as n from lineitem")
def parquet_name_column(t: Tables) -> Frame:
    return t.engine.read_parquet(f"{t.folder}/lineitem.parquet", name_column="file").groupby("file").agg_sql("count(*) as n")


@add("select event_id, user_id, event_type from events")
def json_lines(t: Tables) -> Frame:
    place = _place(t, "json")
    t.events.df.select("event_id", "user_id", "event_type").write.json(place)
    return t.engine.read_json(place, "event_id long, user_id long, event_type string")


@add("select c_custkey, c_name from customer")
def binary_files(t: Tables) -> Frame:
    """Files as bytes, read as text again."""
    place = _place(t, "files")
    t.customer.df.select(F.concat_ws(":", "c_custkey", "c_name").alias("value")).write.text(place)
    lines = t.engine.read_files(f"{place}/*.txt").df.select(F.explode(F.split(F.col("object").cast("string"), "\n")).alias("x")).filter("x <> ''")
    return Frame(lines.select(F.split_part("x", F.lit(":"), F.lit(1)).cast("long").alias("c_custkey"), F.split_part("x", F.lit(":"), F.lit(2)).alias("c_name")))


@add("select cast(sum(value) as bigint) as total, count(*) as n from (select unnest(generate_series(0, 99999)) as value)")
def custom_source(t: Tables) -> Frame:
    return t.engine.read_sequence(100_000, 8).agg_sql("sum(value) as total, count(*) as n")


@add("select r_regionkey, upper(r_name) as name from region")
def local_frames(t: Tables) -> Frame:
    """Into Arrow and back."""
    return t.engine.from_arrow(t.region.to_arrow()).with_columns_sql("upper(r_name) as name").select(["r_regionkey", "name"])


@add("select n_regionkey, count(*) as n from nation group by 1")
def sql_text(t: Tables) -> Frame:
    return t.engine.sql("select n_regionkey, count(*) as n from {nation} group by 1", nation=t.nation)


@add("select l_suppkey, cast(n as bigint) as n from (select l_suppkey, count(*) as n from lineitem group by 1)")
def compute_reuse(t: Tables) -> Frame:
    """A computed frame, read twice."""
    per = t.lineitem.groupby("l_suppkey").agg_sql("count(*) as n").compute()
    return per.join(t.engine.read_dataset(per).select(["l_suppkey"]), on="l_suppkey", how="semi")


def _plain_time(f: Frame) -> Frame:
    return Frame(f.df.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@add("select user_id, time_bucket(interval 6 hour, ts, timestamp '1970-01-01') as ts, count(*) as n, max(value) as top from events group by 1, 2")
def stream_tumbling(t: Tables) -> Frame:
    """Six-hour totals by user from a stream with a watermark, the last ones flushed."""
    return _plain_time(Frame(jobs.tumbling(t.spark, f"{t.folder}/events.parquet")))


@add("""with m as (select *, case when ts - lag(ts) over w < interval 2 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from m)
select user_id, min(ts) as ts, count(*) as n, max(value) as top from s group by user_id, session""")
def stream_sessions(t: Tables) -> Frame:
    """Sessions with a gap of two hours from a stream with a watermark, the last ones flushed."""
    return _plain_time(Frame(jobs.sessions(t.spark, f"{t.folder}/events.parquet")))


@add("""select p.event_id as purchase_id, v.event_id as view_id from (select * from events where event_type = 'purchase') p join (select * from events where event_type = 'view') v
on p.user_id = v.user_id and v.ts >= p.ts - interval 1 hour and v.ts <= p.ts""")
def stream_interval_join(t: Tables) -> Frame:
    return Frame(jobs.interval_join(t.spark, f"{t.folder}/events.parquet"))


@add("select distinct user_id, event_type from events")
def stream_distinct(t: Tables) -> Frame:
    return Frame(jobs.distinct_pairs(t.spark, f"{t.folder}/events.parquet"))


@add("select user_id, count(*) as n, max(value) as top from events group by 1")
def stream_stateful(t: Tables) -> Frame:
    """A state per user kept by a Python operator; the last row of each user holds the final state."""
    return Frame(jobs.running_state(t.spark, f"{t.folder}/events.parquet"))
