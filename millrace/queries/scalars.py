"""Row-wise operators and the string, date-time and JSON functions."""

from __future__ import annotations

import pandas as pd

from millrace.frame import Frame
from millrace.functions.expr import col
from millrace.queries.base import Family, Tables

family = Family()
add = family.add
QUERIES, SQL = family.queries, family.sql


@add("""select l_orderkey, l_linenumber, least(greatest(l_quantity, 5), 20) as l_quantity, least(greatest(l_discount, 0.02), 0.08) as l_discount from lineitem""")
def clip_cols(t: Tables) -> Frame:
    return t.lineitem.clip({"l_quantity": (5.0, 20.0), "l_discount": (0.02, 0.08)}).select(["l_orderkey", "l_linenumber", "l_quantity", "l_discount"])


@add("select c_custkey as id, c_name as name, c_nationkey from customer")
def rename_drop(t: Tables) -> Frame:
    return t.customer.rename({"c_custkey": "id", "c_name": "name"}).drop(["c_acctbal", "c_mktsegment", "no_such_column"])


@add("select p_partkey, round(p_retailprice * 1.1, 2) as gross, concat(p_brand, ',', p_type) as label, p_size + 1 as next_size from part")
def with_columns_sql(t: Tables) -> Frame:
    return t.part.with_columns_sql("round(p_retailprice * 1.1, 2) as gross, concat(p_brand, ',', p_type) as label, p_size + 1 as next_size").select(["p_partkey", "gross", "label", "next_size"])


@add("""select event_id, value + 1 as plus, value - 1 as minus, value * 2 as times, value / 4 as parts, event_id % 7 as rest, -value as negative, 100 - value as rminus, value * value as squared,
value > 50 as high, value >= 50 and user_id < 20 as both_true, value < 10 or user_id = 3 as either, not (value < 10) as not_low, event_id <> 5 as other from events""")
def expression_operators(t: Tables) -> Frame:
    v, u, i = col("value"), col("user_id"), col("event_id")
    return t.events.with_columns(
        {
            "plus": v + 1, "minus": v - 1, "times": 2 * v, "parts": v / 4, "rest": i % 7, "negative": -v, "rminus": 100 - v, "squared": v**2,
            "high": v > 50, "both_true": (v >= 50) & (u < 20), "either": (v < 10) | (u == 3), "not_low": ~(v < 10), "other": i != 5,
        }
    ).drop(["ts", "user_id", "event_type", "value", "props"])


@add("""select p_partkey, upper(p_name) as up, lower(p_brand) as low, contains(p_name, 'a') as has_a, starts_with(p_type, 'P') as promo, ends_with(p_brand, '1') as one, length(p_name) as len,
substring(p_brand, 7, 2) as number from part""")
def str_funcs(t: Tables) -> Frame:
    name, brand, kind = col("p_name").str, col("p_brand").str, col("p_type").str
    made = {"up": name.to_uppercase(), "low": brand.to_lowercase(), "has_a": name.contains("a"), "promo": kind.starts_with("P"), "one": brand.ends_with("1"), "len": name.length().cast("bigint"), "number": brand.substring(7, 2)}
    return t.part.with_columns(made).select(["p_partkey", *made])


@add("""select event_id, hour(ts) as h, minute(ts) as mi, second(ts) as s, millisecond(ts) as ms, microsecond(ts) as us, dayofweek(ts) as wd, week(ts) as wk, month(ts) as mo, year(ts) as y,
ts + interval 90 minute as later, ts - interval 1 month as month_before, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as shown from events""")
def dt_funcs(t: Tables) -> Frame:
    d = col("ts").dt
    parts = {"h": d.hour(), "mi": d.minute(), "s": d.second(), "ms": d.millisecond(), "us": d.microsecond(), "wd": d.weekday(), "wk": d.week(), "mo": d.month(), "y": d.year()}
    made = {n: e.cast("bigint") for n, e in parts.items()} | {"later": d.offset_by(90, "m"), "month_before": d.offset_by(-1, "M"), "shown": d.strftime()}
    return t.events.with_columns(made).select(["event_id", *made])


@add("select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.missing') as missing from events")
def json_extract(t: Tables) -> Frame:
    return t.events.with_columns({"k": col("props").str.json_extract("k"), "missing": col("props").str.json_extract("missing")}).select(["event_id", "k", "missing"])


@add("""select event_id, try_cast(strftime(ts, '%Y-%m-%d') as date) as day, try_cast('x' || event_type as date) as none, try_cast(strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp) as moment from events""")
def strptime(t: Tables) -> Frame:
    e = t.events.with_columns_sql("date_format(ts, 'yyyy-MM-dd') as d, concat('x', event_type) as n, date_format(ts, 'yyyy-MM-dd HH:mm:ss') as m")
    return e.with_columns({"day": col("d").str.strptime("date"), "none": col("n").str.strptime("date"), "moment": col("m").str.strptime()}).select(["event_id", "day", "none", "moment"])


@add("""select p_partkey, p_name from part where p_type in ('PROMO', 'ECONOMY') and p_size between 5 and 15 and p_brand like 'Brand#%2' and p_name not like '%z%' and regexp_matches(p_brand, '[12]2$')""")
def like_in_between(t: Tables) -> Frame:
    p = t.part.filter(col("p_type").is_in(["PROMO", "ECONOMY"]) & col("p_size").between(5, 15) & col("p_brand").like("Brand#%2") & col("p_brand").matches("[12]2$"))
    return p.filter_sql("p_name not like '%z%'").select(["p_partkey", "p_name"])


@add("select event_id, value * 2 + user_id as score from events")
def udf_columns(t: Tables) -> Frame:
    return t.events.with_columns({"score": lambda pdf: pdf["value"] * 2 + pdf["user_id"]}, required=["value", "user_id"], types={"score": "double"}).select(["event_id", "score"])


@add("select event_id, unnest([event_type, upper(event_type)]) as tag from events")
def udf_transform(t: Tables) -> Frame:
    def tags(pdf: pd.DataFrame) -> pd.DataFrame:
        both = pd.concat([pdf.assign(tag=pdf["event_type"]), pdf.assign(tag=pdf["event_type"].str.upper())])
        return both[["event_id", "tag"]]

    return t.events.transform(tags, "event_id long, tag string", required=["event_id", "event_type"])


@add("select event_type, round(sum(value), 4) as total, count(*) as n from events group by 1")
def transform_sql(t: Tables) -> Frame:
    return t.events.transform_sql("round(sum(value), 4) as total, count(*) as n", groupby=["event_type"])


@add(r"""select word, count(*) as n from (select unnest(regexp_split_to_array(trim(text, e' \t\n\r\f\x0b'), '[ \t\n\r\f\x0b]+')) as word from documents where text is not null) where word <> '' group by 1""")
def word_count(t: Tables) -> Frame:
    return t.engine.sql(r"select word, count(*) as n from (select explode(split(text, '[ \\t\\n\\r\\f\\x0B]+')) as word from {d}) where word <> '' group by word", d=t.documents)


@add("select user_id, list_sort(list(distinct event_type)) as kinds, list_contains(list(distinct event_type), 'error') as failed from events group by 1")
def array_functions(t: Tables) -> Frame:
    return t.events.groupby("user_id").agg_sql("array_sort(collect_set(event_type)) as kinds, array_contains(collect_set(event_type), 'error') as failed")
