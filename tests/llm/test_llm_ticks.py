"""Nearest time and run collapsing: brute force and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm.catalogue import QUERIES, SQL
from millrace.llm.nearest_time import nearest_time_join
from millrace.llm.run_collapse import agglomerate, collapse_runs
from millrace.plans.compare import rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, sf, name):
    assert rows_of(QUERIES[name](spark, sf)) == sql_rows(con, SQL[name])


@pytest.mark.parametrize("spans", [1, 3, 30])
def test_nearest_against_brute_force(spark, spans):
    rng = random.Random(spans)
    left = [(k, rng.choice(["a", "b", None]), rng.randrange(-60, 300) if rng.random() > 0.05 else None) for k in range(150)]
    right = [(k, rng.choice(["a", "b", None]), rng.randrange(-60, 300) if rng.random() > 0.05 else None, rng.choice([1.0, None])) for k in range(90)]
    right += right[:9]  # repeated
    left += left[:9]
    l = spark.createDataFrame(left, "id int, s string, t long").repartition(3)
    r = spark.createDataFrame(right, "seq int, S string, t long, v double").repartition(3)
    got = nearest_time_join(l, r, by="s", right_by="S", on="t", tolerance=7, tie=["seq"], how="left", spans=spans)
    assert got.columns == ["id", "s", "t", "seq", "S_2", "t_2", "v"]
    want = []
    for i, s, t in left:
        near = [(abs(t2 - t), t2, q) for q, s2, t2, _ in right if s is not None and t is not None and s2 == s and t2 is not None and abs(t2 - t) <= 7]
        want.append((i, min(near)[2] if near else None))
    assert sorted(((x["id"], x["seq"]) for x in got.collect()), key=repr) == sorted(want, key=repr)
    inner = nearest_time_join(l, r, by="s", right_by="S", on="t", tolerance=7, tie=["seq"], spans=spans)
    assert inner.count() == sum(q is not None for _, q in want)


def test_nearest_of_empty_tables(spark):
    l = spark.createDataFrame([(1, "a", 5)], "id int, s string, t long")
    assert nearest_time_join(l, l.limit(0), by="s", on="t", tolerance=3).count() == 0
    assert nearest_time_join(l, l.limit(0), by="s", on="t", tolerance=3, how="left").count() == 1
    assert nearest_time_join(l.limit(0), l, by="s", on="t", tolerance=3, how="left").count() == 0
    assert nearest_time_join(l, l, by="s", on="t", tolerance=0).count() == 1


def test_nearest_shuffles_each_side_once(spark):
    l = spark.createDataFrame([("a", 1), ("b", 2)], "s string, t long")
    p = nearest_time_join(l, l, by="s", on="t", tolerance=3)._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange") == 2 and "Join" not in p


def test_agglomerate():
    import numpy as np

    assert agglomerate(np.array([0.5, 2.0, 0.0, 1.0, np.nan, np.inf])).tolist() == [0, 2, 5, 6]
    assert agglomerate(np.array([])).tolist() == [0]


def brute(rows, limits, gap):
    def near(a, b, most):
        if a is None or b is None:
            return a is None and b is None
        return abs(a - b) <= most

    rows = sorted({r for r in rows if None not in r[:4]}, key=lambda r: r[:4])
    runs = []
    for r in rows:
        p = runs[-1][-1] if runs else None
        if p and p[:2] == r[:2] and r[2] - p[2] <= gap and all(near(a, b, m) for a, b, m in zip(p[4:], r[4:], limits)):
            runs[-1].append(r)
        else:
            runs.append([r])
    return sorted((x[0][3], x[-1][3], len(x), x[-1][2] - x[0][2]) for x in runs)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_collapse_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    rows = []
    for k in range(400):
        v = rng.choice([1.0, 1.001, 1.004, 2.0, None, float("nan")])
        rows.append((rng.choice(["a", "b", None]), rng.randrange(2), rng.randrange(1500), k, v, rng.choice([5, 7, 20, None])))
    rows += [("long", 0, k, 1000 + k, 3.0, 1) for k in range(300)]  # one run over several slices
    rows += rows[5:60]
    df = spark.createDataFrame(rows, "s string, d int, t long, i long, v double, n long")
    df = df.withColumns({"k0": F.lit(1), "slice": F.lit(2), "EDGE": F.lit(3)})
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = collapse_runs(df, by=["s", "d"], time="t", id="i", limits={"v": 0.003, "n": 2}, max_gap=30)
        found = sorted((r["first_i"], r["last_i"], r["n_events"], r["duration"]) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == brute(rows, (0.003, 2), 30)


def test_collapse_of_an_empty_table(spark):
    df = spark.createDataFrame([], "s string, t long, i long, v double")
    assert collapse_runs(df, by=["s"], time="t", id="i", limits={"v": 1}, max_gap=5).count() == 0
