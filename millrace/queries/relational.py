"""Scans, projections, joins, aggregates, top-k and set operations; the TPC-H family on the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.frame import Frame
from millrace.functions.expr import col, when
from millrace.queries.base import Family, Tables

family = Family()
add = family.add
QUERIES, SQL = family.queries, family.sql

REVENUE = "l_extendedprice * (1 - l_discount)"


@add("""select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem
where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24""")
def scan_filter_project(t: Tables) -> Frame:
    return t.lineitem.filter_sql("l_shipdate >= timestamp_ntz '1997-01-01' and l_shipdate < timestamp_ntz '1998-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24").select(
        ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"]
    )


@add("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc_price,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) as sum_charge, round(avg(l_quantity), 6) as avg_qty, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
from lineitem where l_shipdate <= timestamp '2001-09-01' group by 1, 2""")
def q1_agg(t: Tables) -> Frame:
    return (
        t.lineitem.filter_sql("l_shipdate <= timestamp_ntz '2001-09-01'")
        .with_columns_sql(f"{REVENUE} as disc_price, {REVENUE} * (1 + l_tax) as charge")
        .groupby(["l_returnflag", "l_linestatus"], orderby=["l_returnflag", ("l_linestatus", "desc")])
        .agg_sql(
            "sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price, round(sum(disc_price), 4) as sum_disc_price, round(sum(charge), 6) as sum_charge, "
            "round(avg(l_quantity), 6) as avg_qty, round(avg(l_discount), 6) as avg_disc, count(*) as count_order"
        )
    )


@add("""select l_returnflag, l_linestatus, sum(l_quantity) as l_quantity_sum, max(l_extendedprice) as l_extendedprice_max, min(l_extendedprice) as l_extendedprice_min,
round(avg(l_quantity), 6) as l_quantity_avg, count(*) as count from lineitem group by 1, 2""")
def agg_dict_naming(t: Tables) -> Frame:
    got = t.lineitem.groupby(["l_returnflag", "l_linestatus"]).agg({"l_quantity": ["sum", "avg"], "l_extendedprice": ["max", "min"], "*": "count"})
    return Frame(got.df.withColumn("l_quantity_avg", F.round("l_quantity_avg", 6)))


@add("""select o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1998-03-15' and l_shipdate > timestamp '1998-03-15' group by 1, 2 order by revenue desc, o_orderdate, o_orderkey limit 10""")
def q3_join_topk(t: Tables) -> Frame:
    customer = t.customer.filter(col("c_mktsegment") == "BUILDING")
    orders = t.orders.filter_sql("o_orderdate < timestamp_ntz '1998-03-15'")
    lines = t.lineitem.filter_sql("l_shipdate > timestamp_ntz '1998-03-15'")
    return (
        lines.join(orders.join(customer, left_on="o_custkey", right_on="c_custkey"), left_on="l_orderkey", right_on="o_orderkey")
        .groupby(["l_orderkey", "o_orderdate"])
        .agg_sql(f"round(sum({REVENUE}), 4) as revenue")
        .rename({"l_orderkey": "o_orderkey"})
        .top_k(["revenue", "o_orderdate", "o_orderkey"], 10, [True, False, False])
    )


@add("""select o_orderpriority, count(*) as order_count from orders where o_orderdate >= timestamp '1997-07-01' and o_orderdate < timestamp '1997-10-01'
and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') group by 1""")
def q4_exists(t: Tables) -> Frame:
    returned = t.lineitem.filter_sql("l_returnflag = 'R'")
    late = t.orders.filter_sql("o_orderdate >= timestamp_ntz '1997-07-01' and o_orderdate < timestamp_ntz '1997-10-01'")
    return late.join(returned, left_on="o_orderkey", right_on="l_orderkey", how="semi").groupby("o_orderpriority", orderby=["o_orderpriority"]).agg_sql("count(*) as order_count")


@add("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where r_name = 'ASIA' and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1999-01-01' group by 1""")
def q5_multi_join(t: Tables) -> Frame:
    asia = t.nation.join(t.region.filter_sql("r_name = 'ASIA'"), left_on="n_regionkey", right_on="r_regionkey", how="semi")
    suppliers = t.supplier.join(asia, left_on="s_nationkey", right_on="n_nationkey")
    orders = t.orders.filter_sql("o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1999-01-01'").join(t.customer, left_on="o_custkey", right_on="c_custkey")
    lines = t.lineitem.join(orders, left_on="l_orderkey", right_on="o_orderkey")
    return lines.join(suppliers, left_on=["l_suppkey", "c_nationkey"], right_on=["s_suppkey", "s_nationkey"]).groupby("n_name").agg_sql(f"round(sum({REVENUE}), 4) as revenue")


@add("""select round(sum(l_extendedprice * l_discount), 4) as revenue from lineitem
where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01' and l_discount between 0.049 and 0.071 and l_quantity < 24""")
def q6_agg(t: Tables) -> Frame:
    return t.lineitem.filter_sql("l_shipdate >= date '1997-01-01' and l_shipdate < date '1997-01-01' + interval '1' year and l_discount between 0.049 and 0.071 and l_quantity < 24").agg_sql(
        "round(sum(l_extendedprice * l_discount), 4) as revenue"
    )


@add("""select n1.n_name as supp_nation, n2.n_name as cust_nation, year(l_shipdate) as l_year, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue
from supplier join lineitem on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation n1 on s_nationkey = n1.n_nationkey
join nation n2 on c_nationkey = n2.n_nationkey where n1.n_regionkey = 2 and n2.n_regionkey = 3 and l_shipdate between timestamp '1996-01-01' and timestamp '1997-12-31' group by 1, 2, 3""")
def q7_volume(t: Tables) -> Frame:
    nation = t.nation
    supplier = t.supplier.join(nation.filter_sql("n_regionkey = 2").rename({"n_name": "supp_nation"}), left_on="s_nationkey", right_on="n_nationkey")
    customer = t.customer.join(nation.filter_sql("n_regionkey = 3").rename({"n_name": "cust_nation"}), left_on="c_nationkey", right_on="n_nationkey")
    lines = t.lineitem.filter_sql("l_shipdate between timestamp_ntz '1996-01-01' and timestamp_ntz '1997-12-31'").with_columns({"l_year": col("l_shipdate").dt.year()})
    orders = t.orders.join(customer, left_on="o_custkey", right_on="c_custkey")
    return (
        lines.join(supplier, left_on="l_suppkey", right_on="s_suppkey").join(orders, left_on="l_orderkey", right_on="o_orderkey").groupby(["supp_nation", "cust_nation", "l_year"]).agg_sql(f"round(sum({REVENUE}), 4) as revenue")
    )


@add("""select year(o_orderdate) as o_year, round(sum(case when n_name = (select min(n_name) from nation where n_regionkey = 1) then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 8) as mkt_share
from lineitem join orders on l_orderkey = o_orderkey join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on s_nationkey = n_nationkey
where p_type = 'ECONOMY' group by 1""")
def q8_share(t: Tables) -> Frame:
    first = t.nation.filter_sql("n_regionkey = 1").agg_sql("min(n_name) as home")
    nation = t.nation.cross(first)
    lines = t.lineitem.join(t.part.filter_sql("p_type = 'ECONOMY'"), left_on="l_partkey", right_on="p_partkey", how="semi").join(t.supplier.join(nation, left_on="s_nationkey", right_on="n_nationkey"), left_on="l_suppkey", right_on="s_suppkey")
    got = lines.join(t.orders, left_on="l_orderkey", right_on="o_orderkey").with_columns({"o_year": col("o_orderdate").dt.year()})
    return got.groupby("o_year").agg_sql(f"round(sum(case when n_name = home then {REVENUE} else 0 end) / sum({REVENUE}), 8) as mkt_share")


@add("""select n_name, year(o_orderdate) as o_year, round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity), 2) as amount from lineitem join part on p_partkey = l_partkey
join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join nation on s_nationkey = n_nationkey where p_brand like '%1' group by 1, 2""")
def q9_profit(t: Tables) -> Frame:
    parts = t.part.filter_sql("p_brand like '%1'")
    got = t.lineitem.join(parts, left_on="l_partkey", right_on="p_partkey").join(t.supplier.join(t.nation, left_on="s_nationkey", right_on="n_nationkey"), left_on="l_suppkey", right_on="s_suppkey")
    got = got.join(t.orders, left_on="l_orderkey", right_on="o_orderkey").with_columns({"o_year": col("o_orderdate").dt.year()})
    return got.groupby(["n_name", "o_year"]).agg_sql(f"round(sum({REVENUE} - p_retailprice * l_quantity), 2) as amount")


@add("""select c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, n_name from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
join nation on c_nationkey = n_nationkey where o_orderdate >= timestamp '1997-10-01' and o_orderdate < timestamp '1998-01-01' and l_returnflag = 'R' group by 1, 2, 4 order by revenue desc, c_custkey limit 20""")
def q10_topk(t: Tables) -> Frame:
    orders = t.orders.filter_sql("o_orderdate >= timestamp_ntz '1997-10-01' and o_orderdate < timestamp_ntz '1998-01-01'")
    got = t.lineitem.filter_sql("l_returnflag = 'R'").join(orders, left_on="l_orderkey", right_on="o_orderkey").join(t.customer.join(t.nation, left_on="c_nationkey", right_on="n_nationkey"), left_on="o_custkey", right_on="c_custkey")
    got = got.groupby(["o_custkey", "c_name", "n_name"]).agg_sql(f"round(sum({REVENUE}), 4) as revenue").rename({"o_custkey": "c_custkey"})
    return got.top_k(["revenue", "c_custkey"], 20, [True, False])


@add("""select s_nationkey, l_partkey, round(sum(l_extendedprice), 2) as value from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2
having sum(l_extendedprice) > (select sum(l_extendedprice) * 0.00005 from lineitem)""")
def q11_share_of_total(t: Tables) -> Frame:
    total = t.lineitem.agg_sql("sum(l_extendedprice) * 0.00005 as least")
    value = t.lineitem.join(t.supplier, left_on="l_suppkey", right_on="s_suppkey").groupby(["s_nationkey", "l_partkey"]).agg_sql("sum(l_extendedprice) as v")
    return value.cross(total).filter_sql("v > least").with_columns_sql("round(v, 2) as value").select(["s_nationkey", "l_partkey", "value"])


@add("""select l_returnflag, cast(sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as bigint) as high_line_count,
cast(sum(case when o_orderpriority not in ('1-URGENT', '2-HIGH') then 1 else 0 end) as bigint) as low_line_count from orders join lineitem on o_orderkey = l_orderkey group by 1""")
def q12_bool_sum(t: Tables) -> Frame:
    got = t.lineitem.join(t.orders, left_on="l_orderkey", right_on="o_orderkey").with_columns({"high": col("o_orderpriority").is_in(["1-URGENT", "2-HIGH"]), "low": ~col("o_orderpriority").is_in(["1-URGENT", "2-HIGH"])})
    return got.groupby("l_returnflag").agg({"high": "sum", "low": "sum"}).rename({"high_sum": "high_line_count", "low_sum": "low_line_count"})


@add("""select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left join orders on c_custkey = o_custkey and o_orderstatus <> 'F' group by 1) group by 1""")
def q13_left_counts(t: Tables) -> Frame:
    orders = t.orders.filter(col("o_orderstatus") != "F")
    per = t.customer.join(orders, left_on="c_custkey", right_on="o_custkey", how="left").groupby("c_custkey").agg_sql("count(o_orderkey) as c_count")
    return per.groupby("c_count").agg_sql("count(*) as custdist")


@add("""select round(100.0 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 8) as promo_revenue
from lineitem join part on l_partkey = p_partkey where l_shipdate >= timestamp '1997-09-01' and l_shipdate < timestamp '1997-12-01'""")
def q14_case(t: Tables) -> Frame:
    lines = t.lineitem.filter_sql("l_shipdate >= timestamp_ntz '1997-09-01' and l_shipdate < timestamp_ntz '1997-12-01'").join(t.part, left_on="l_partkey", right_on="p_partkey")
    lines = lines.with_columns_sql(f"{REVENUE} as revenue").with_columns({"promo": when(col("p_type").str.starts_with("PROMO"), col("revenue")).otherwise(0.0)})
    return lines.agg_sql("round(100.0 * sum(promo) / sum(revenue), 8) as promo_revenue")


@add("""with r as (select l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) as total_revenue from lineitem where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1997-04-01' group by 1)
select s_suppkey, s_name, total_revenue from supplier join r on s_suppkey = l_suppkey where total_revenue = (select max(total_revenue) from r)""")
def q15_scalar_max(t: Tables) -> Frame:
    revenue = t.lineitem.filter_sql("l_shipdate >= timestamp_ntz '1997-01-01' and l_shipdate < timestamp_ntz '1997-04-01'").groupby("l_suppkey").agg_sql(f"round(sum({REVENUE}), 4) as total_revenue")
    best = revenue.agg_sql("max(total_revenue) as best")
    top = revenue.cross(best).filter_sql("total_revenue = best")
    return t.supplier.join(top, left_on="s_suppkey", right_on="l_suppkey").select(["s_suppkey", "s_name", "total_revenue"])


@add("""select p_brand, p_type, p_size, count(distinct l_suppkey) as supplier_cnt from lineitem join part on l_partkey = p_partkey
where p_brand <> 'Brand#45' and p_type not like 'MEDIUM%' and p_size in (9, 14, 19, 23, 36, 45, 49, 3) and l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0) group by 1, 2, 3""")
def q16_distinct_anti(t: Tables) -> Frame:
    parts = t.part.filter_sql("p_brand <> 'Brand#45' and p_type not like 'MEDIUM%' and p_size in (9, 14, 19, 23, 36, 45, 49, 3)")
    good = t.lineitem.join(t.supplier.filter_sql("s_acctbal < 0"), left_on="l_suppkey", right_on="s_suppkey", how="anti")
    return good.join(parts, left_on="l_partkey", right_on="p_partkey").groupby(["p_brand", "p_type", "p_size"]).count_distinct("l_suppkey").rename({"l_suppkey": "supplier_cnt"})


@add("""select round(sum(l_extendedprice) / 7.0, 4) as avg_yearly from lineitem join part on p_partkey = l_partkey
where p_brand = 'Brand#23' and l_quantity < (select 0.5 * avg(l_quantity) from lineitem l2 where l2.l_partkey = p_partkey)""")
def q17_avg_sub(t: Tables) -> Frame:
    parts = t.part.filter_sql("p_brand = 'Brand#23'").select(["p_partkey"])
    lines = t.lineitem.join(parts, left_on="l_partkey", right_on="p_partkey")
    mean = lines.groupby("l_partkey").agg_sql("0.5 * avg(l_quantity) as least")
    return lines.join(mean, on="l_partkey").filter_sql("l_quantity < least").agg_sql("round(sum(l_extendedprice) / 7.0, 4) as avg_yearly")


@add("""select c_name, c_custkey, o_orderkey, o_totalprice, sum(l_quantity) as sum_qty from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey
where o_orderkey in (select l_orderkey from lineitem group by 1 having sum(l_quantity) > 200) group by 1, 2, 3, 4 order by o_totalprice desc, o_orderkey limit 100""")
def q18_having(t: Tables) -> Frame:
    # the totals of the large orders are the totals asked for: lineitem is read once
    large = t.lineitem.groupby("l_orderkey").agg_sql("sum(l_quantity) as sum_qty").filter_sql("sum_qty > 200")
    got = large.join(t.orders, left_on="l_orderkey", right_on="o_orderkey").join(t.customer, left_on="o_custkey", right_on="c_custkey")
    got = got.rename({"l_orderkey": "o_orderkey", "o_custkey": "c_custkey"}).select(["c_name", "c_custkey", "o_orderkey", "o_totalprice", "sum_qty"])
    return got.top_k(["o_totalprice", "o_orderkey"], 100, [True, False])


@add("""select round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from lineitem join part on p_partkey = l_partkey
where (p_brand = 'Brand#12' and p_size between 1 and 15 and l_quantity between 1 and 21) or (p_brand = 'Brand#23' and p_size between 1 and 30 and l_quantity between 10 and 30)
or (p_brand = 'Brand#34' and p_size between 1 and 45 and l_quantity between 20 and 40)""")
def q19_disjunction(t: Tables) -> Frame:
    got = t.lineitem.join(t.part, left_on="l_partkey", right_on="p_partkey").filter_sql(
        "(p_brand = 'Brand#12' and p_size between 1 and 15 and l_quantity between 1 and 21) or (p_brand = 'Brand#23' and p_size between 1 and 30 and l_quantity between 10 and 30) "
        "or (p_brand = 'Brand#34' and p_size between 1 and 45 and l_quantity between 20 and 40)"
    )
    return got.agg_sql(f"round(sum({REVENUE}), 4) as revenue")


@add("""select s_suppkey, s_name from supplier where s_suppkey in (select l_suppkey from lineitem join part on p_partkey = l_partkey where p_brand like 'Brand#1%' and year(l_shipdate) = 1998
group by l_suppkey, l_partkey having sum(l_quantity) > 60)""")
def q20_nested_in(t: Tables) -> Frame:
    parts = t.part.filter(col("p_brand").str.starts_with("Brand#1"))
    lines = t.lineitem.filter(col("l_shipdate").dt.year() == 1998).join(parts, left_on="l_partkey", right_on="p_partkey", how="semi")
    much = lines.groupby(["l_suppkey", "l_partkey"]).agg_sql("sum(l_quantity) as q").filter_sql("q > 60")
    return t.supplier.join(much, left_on="s_suppkey", right_on="l_suppkey", how="semi").select(["s_suppkey", "s_name"])


@add("""select s_name, count(*) as numwait from supplier join lineitem l1 on s_suppkey = l1.l_suppkey join orders on o_orderkey = l1.l_orderkey where o_orderstatus = 'F' and l1.l_returnflag = 'R'
and exists (select 1 from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)
and not exists (select 1 from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_returnflag = 'R') group by 1""")
def semi_neq(t: Tables) -> Frame:
    l1 = t.lineitem.filter_sql("l_returnflag = 'R'").join(t.orders.filter_sql("o_orderstatus = 'F'"), left_on="l_orderkey", right_on="o_orderkey", how="semi")
    l2 = t.lineitem.select(["l_orderkey", "l_suppkey"])
    l3 = t.lineitem.filter_sql("l_returnflag = 'R'").select(["l_orderkey", "l_suppkey"])
    other = "l.l_orderkey = r.l_orderkey and l.l_suppkey <> r.l_suppkey"
    got = l1.join_on(l2, other, "semi").join_on(l3, other, "anti")
    return got.join(t.supplier, left_on="l_suppkey", right_on="s_suppkey").groupby("s_name").agg_sql("count(*) as numwait")


@add("""select c_nationkey, count(*) as numcust, round(sum(c_acctbal), 2) as totacctbal from customer where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0)
and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') group by 1""")
def q22_anti_scalar(t: Tables) -> Frame:
    mean = t.customer.filter_sql("c_acctbal > 0").agg_sql("avg(c_acctbal) as mean")
    rich = t.customer.cross(mean).filter_sql("c_acctbal > mean")
    return rich.join(t.orders.filter_sql("o_orderstatus = 'P'"), left_on="c_custkey", right_on="o_custkey", how="anti").groupby("c_nationkey").agg_sql("count(*) as numcust, round(sum(c_acctbal), 2) as totacctbal")


@add("select c_custkey, c_name, o_orderkey, o_totalprice from customer left join orders on c_custkey = o_custkey")
def join_left(t: Tables) -> Frame:
    return t.customer.join(t.orders, left_on="c_custkey", right_on="o_custkey", how="left").select(["c_custkey", "c_name", "o_orderkey", "o_totalprice"])


@add("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def join_semi(t: Tables) -> Frame:
    return t.customer.join(t.orders.filter_sql("o_orderstatus = 'P'"), left_on="c_custkey", right_on="o_custkey", how="semi").select(["c_custkey", "c_name"])


@add("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def join_anti(t: Tables) -> Frame:
    return t.customer.join(t.orders.filter_sql("o_orderstatus = 'P'"), left_on="c_custkey", right_on="o_custkey", how="anti").select(["c_custkey", "c_name"])


@add("""select coalesce(c.n, s.n) as n, c.customers, s.suppliers from (select c_nationkey as n, count(*) as customers from customer where c_acctbal > 9000 group by 1) c
full join (select s_nationkey as n, count(*) as suppliers from supplier group by 1) s on c.n = s.n""")
def join_full(t: Tables) -> Frame:
    c = t.customer.filter_sql("c_acctbal > 9000").groupby("c_nationkey").agg_sql("count(*) as customers").rename({"c_nationkey": "n"})
    s = t.supplier.groupby("s_nationkey").agg_sql("count(*) as suppliers").rename({"s_nationkey": "n"})
    return c.join(s, on="n", how="full")


@add("""select a.n_name as n_name, b.n_name as n_name_2, a.n_regionkey from nation a join nation b on a.n_regionkey = b.n_regionkey""")
def join_suffix(t: Tables) -> Frame:
    return t.nation.join(t.nation, on="n_regionkey").select(["n_name", "n_name_2", "n_regionkey"])


@add("select n_name as name from nation union all select r_name as name from region union all select n_name as name from nation")
def union_all(t: Tables) -> Frame:
    nation, region = t.nation.select(["n_name"]).rename({"n_name": "name"}), t.region.select(["r_name"]).rename({"r_name": "name"})
    return nation.union(region).union(nation)


@add("select distinct l_returnflag, l_linestatus from lineitem")
def distinct_keys(t: Tables) -> Frame:
    return t.lineitem.distinct(["l_returnflag", "l_linestatus"])


@add("select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'")
def set_intersect(t: Tables) -> Frame:
    return t.orders.filter_sql("o_orderstatus = 'F'").select(["o_custkey"]).intersect(t.orders.filter_sql("o_orderstatus = 'O'").select(["o_custkey"]))


@add("select o_custkey from orders where o_orderstatus = 'F' except all select o_custkey from orders where o_orderstatus = 'O'")
def set_except(t: Tables) -> Frame:
    return t.orders.filter_sql("o_orderstatus = 'F'").select(["o_custkey"]).except_all(t.orders.filter_sql("o_orderstatus = 'O'").select(["o_custkey"]))


@add("select l_returnflag, count(distinct l_partkey) as l_partkey from lineitem group by 1")
def count_distinct_grouped(t: Tables) -> Frame:
    return t.lineitem.groupby("l_returnflag").count_distinct("l_partkey")


@add("select count(distinct l_suppkey) as l_suppkey from lineitem")
def count_distinct_global(t: Tables) -> Frame:
    return t.lineitem.count_distinct("l_suppkey")


@add("select count(*) as count from lineitem")
def count_rows(t: Tables) -> Frame:
    return t.lineitem.count()


@add("select sum(l_quantity) as l_quantity_sum, round(sum(l_extendedprice), 2) as l_extendedprice_sum from lineitem")
def sum_columns(t: Tables) -> Frame:
    got = t.lineitem.sum(["l_quantity", "l_extendedprice"])
    return Frame(got.df.withColumn("l_extendedprice_sum", F.round("l_extendedprice_sum", 2)))


@add("select min(l_quantity) as l_quantity_min, min(l_shipdate) as l_shipdate_min from lineitem")
def min_columns(t: Tables) -> Frame:
    return t.lineitem.min(["l_quantity", "l_shipdate"])


@add("select max(o_totalprice) as o_totalprice_max, max(o_orderdate) as o_orderdate_max from orders")
def max_columns(t: Tables) -> Frame:
    return t.orders.max(["o_totalprice", "o_orderdate"])


@add("select round(avg(l_quantity), 6) as l_quantity_mean from lineitem")
def mean_columns(t: Tables) -> Frame:
    return Frame(t.lineitem.mean("l_quantity").df.select(F.round("l_quantity_mean", 6).alias("l_quantity_mean")))


@add("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_k(t: Tables) -> Frame:
    return t.orders.select(["o_orderkey", "o_totalprice"]).top_k(["o_totalprice", "o_orderkey"], 25, [True, False])


@add("select s_suppkey, s_name, s_acctbal from supplier order by s_acctbal, s_suppkey")
def sort_global(t: Tables) -> Frame:
    return t.supplier.select(["s_suppkey", "s_name", "s_acctbal"]).sort(["s_acctbal", "s_suppkey"])


@add("select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as qty from lineitem group by cube (1, 2)")
def group_cube(t: Tables) -> Frame:
    return t.lineitem.cube(["l_returnflag", "l_linestatus"], "count(*) as n, sum(l_quantity) as qty")


@add("select n_regionkey, c_mktsegment, count(*) as n from customer join nation on c_nationkey = n_nationkey group by rollup (1, 2)")
def group_rollup(t: Tables) -> Frame:
    return t.customer.join(t.nation, left_on="c_nationkey", right_on="n_nationkey").rollup(["n_regionkey", "c_mktsegment"], "count(*) as n")


@add("select l_returnflag, l_shipdate_year, n from (select l_returnflag, year(l_shipdate) as l_shipdate_year, count(*) as n from lineitem group by grouping sets ((l_returnflag), (year(l_shipdate))))")
def grouping_sets(t: Tables) -> Frame:
    lines = t.lineitem.with_columns({"l_shipdate_year": col("l_shipdate").dt.year()})
    return t.engine.sql("select l_returnflag, l_shipdate_year, count(*) as n from {lines} group by grouping sets ((l_returnflag), (l_shipdate_year))", lines=lines)


@add("""select o_custkey, o_orderkey, row_number() over w as rn, rank() over (partition by o_custkey order by o_orderstatus) as rk, dense_rank() over (partition by o_custkey order by o_orderstatus) as dr,
ntile(4) over w as quarter from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)""")
def ranking_functions(t: Tables) -> Frame:
    return t.engine.sql(
        "select o_custkey, o_orderkey, cast(row_number() over w as bigint) as rn, cast(rank() over s as bigint) as rk, cast(dense_rank() over s as bigint) as dr, cast(ntile(4) over w as bigint) as quarter from {orders} "
        "window w as (partition by o_custkey order by o_totalprice desc, o_orderkey), s as (partition by o_custkey order by o_orderstatus)",
        orders=t.orders,
    )


@add("""select l_returnflag, round(stddev_samp(l_quantity), 6) as sd, round(var_samp(l_quantity), 5) as var from lineitem group by 1""")
def group_spread(t: Tables) -> Frame:
    return t.lineitem.groupby("l_returnflag").agg_sql("round(stddev_samp(l_quantity), 6) as sd, round(var_samp(l_quantity), 5) as var")


@add()
def approx_distinct(t: Tables) -> Frame:
    return t.lineitem.groupby("l_returnflag").agg_sql("approx_count_distinct(l_partkey) as parts")
