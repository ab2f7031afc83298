"""Skewed keys, rolling state and spikes: brute force and edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import rolling
from millrace.operators.skew import value_frequencies, weighted_profile
from millrace.operators.spikes import fit_tail, flag_magnitudes, flag_readings, tail_cutoff


def test_profile(spark):
    rng = random.Random(3)
    data = [("hot", float(rng.randrange(40))) for _ in range(900)] + [("one", 5.0), ("two", 1.0), ("two", 4.0), (None, 2.0), (None, 2.0), ("none", None), ("nan", float("nan")), ("nan", 1.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    got = {r["k"]: r for r in weighted_profile(value_frequencies(df, ["k"], "v"), ["k"], "v", percentiles=[0.0, 0.3, 0.5, 1.0]).collect()}
    assert set(got) == {"hot", "one", "two", None, "nan"}
    for k in ("hot", "one", "two", None):
        v = sorted(x for a, x in data if a == k)
        for p, name in ((0.0, "p0"), (0.3, "p30"), (0.5, "p50"), (1.0, "p100")):
            assert math.isclose(got[k][name], np.percentile(v, p * 100))
        assert (got[k]["n"], got[k]["n_distinct"]) == (len(v), len(set(v)))
        assert got[k]["mode"] == min(set(v), key=lambda x: (-v.count(x), x))
    assert math.isnan(got["nan"]["p100"])
    assert weighted_profile(value_frequencies(df.limit(0), ["k"], "v"), ["k"], "v", percentiles=[0.5]).count() == 0


def test_profile_of_one_hot_key_uses_several_slices(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    r = weighted_profile(value_frequencies(df, ["k"], "v"), ["k"], "v", percentiles=[0.25]).first()
    assert (r["n"], r["p25"]) == (20_000, 4999.75)


def _daily(spark, data):
    return spark.createDataFrame(data, "k string, d int, x long, y double")


def test_rolling_steps_equal_the_whole(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.randrange(12), rng.randrange(9), rng.choice([1.25, 2.5, None])) for _ in range(80)] + [("c", 3, None, float("nan")), (None, 1, 1, 1.0), ("a", None, 1, 1.0)]
    m = {"x": "x", "y": "y"}
    daily = rolling.daily_amounts(_daily(spark, data), key="k", day=F.col("d"), measures=m).cache()
    whole = rolling.build_state(daily, [3, 5], first=0, last=14)
    cols = ["key", "day", "events_3", "x_sum_5", "y_sum_3", "y_count_5", "y_odd_5"]
    want = {tuple(r) for r in whole.select(*cols).collect()}
    for r in whole.collect():
        mine = [z for z in data if z[0] == r["key"] and z[1] is not None and r["day"] - 4 <= z[1] <= r["day"]]
        assert r["x_sum_5"] == sum(z[2] or 0 for z in mine)
        ys = [z[3] for z in mine if z[3] is not None]
        assert (r["y_count_5"], r["y_odd_5"]) == (sum(not math.isnan(y) for y in ys), sum(math.isnan(y) for y in ys))
    # day by day from the state of day 0
    state = rolling.build_state(daily, [3, 5], first=0, last=0)
    steps = state
    for day in range(1, 6):
        state = rolling.roll_forward(state, daily, [3, 5], day, version=day)
        steps = steps.unionByName(state)
    assert {tuple(r) for r in steps.select(*cols).collect()} == {w for w in want if w[1] <= 5}


def test_correction_touches_its_days_only(spark):
    m = {"x": "x"}
    early = [("a", 1, 5, 0.0), ("a", 6, 1, 0.0)]
    late = [("a", 2, 10, 0.0), ("z", 2, 10, 0.0)]
    daily = rolling.daily_amounts(_daily(spark, early), key="k", day=F.col("d"), measures=m)
    state = rolling.build_state(daily, [3], first=0, last=8)
    new = rolling.correct_state(state, rolling.daily_amounts(_daily(spark, late), key="k", day=F.col("d"), measures=m), [3], version=1)
    assert {(r["key"], r["day"], r["x_sum_3"], r["version"]) for r in new.collect()} == {("a", 2, 15, 1), ("a", 3, 15, 1), ("a", 4, 10, 1)}
    now = {(r["day"]): r["x_sum_3"] for r in rolling.latest(state.unionByName(new)).collect()}
    assert [now[d] for d in range(9)] == [0, 5, 15, 15, 10, 0, 1, 1, 1]
    assert rolling.build_state(daily.limit(0), [3]).count() == 0


def _readings(spark, values, other=None, kind="q", source="s"):
    rows = [(kind, source, k, k, v, None if other is None else other[k]) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "kind string, src string, time long, id long, v double, o double")


def _flags(df, **how):
    how = {"stuck": (20, 10), **how}
    got = flag_readings(df, by=["kind", "src"], kind="kind", time="time", id="id", values=["v", "o"], others={"v": "o"}, **how).filter("field = 'v'")
    return {r["id"]: r for r in got.collect()}


def walk(n, seed=1):
    rng = random.Random(seed)
    x, out = 1000, []
    for _ in range(n):
        x += rng.choice([-1, 1, 2, -2, 0])
        out.append(x / 100)
    return out


@pytest.mark.parametrize("partitions", [1, 8])
def test_spikes(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        v = walk(800)
        for k in (100, 300, 301, 302, 799):
            v[k] += 40.0
        for k in range(500, 506):  # six in a row are a level, not a spike
            v[k] -= 5.0
        v[600:] = [x + 30.0 for x in v[600:]]
        v[50], v[51], v[52] = float("nan"), 0.0, None
        df = _readings(spark, v)
        got = _flags(df.union(df))  # every row twice
        found = {k for k, r in got.items() if r["spike"] and r["changes"] > 25}
        assert found == {100, 300, 301, 302}
        assert all(r["residual"] > r["cutoff"] for r in got.values() if r["spike"])
        # the same in another unit
        small = _flags(_readings(spark, [None if x is None else x * 1e-8 for x in v]))
        assert {k for k, r in small.items() if r["spike"] and r["changes"] > 25} == found
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


@pytest.mark.parametrize("partitions", [1, 8])
def test_stuck(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        v, o = walk(400), [10 + k / 100 for k in range(400)]
        v[100:120] = [7.77] * 20  # twenty, and the other side moves
        v[200:219] = [8.88] * 19  # too short
        v[300:330], o[300:330] = [6.66] * 30, [5.0] * 30  # the other side stands still
        v[110] = None  # skipped, doesn't interrupt
        v[120] = 7.77
        got = {k for k, r in _flags(_readings(spark, v, o)).items() if r["stuck"]}
        assert got == set(range(100, 121)) - {110}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_stuck_runs_over_many_slices(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    v, o = walk(4000), [10 + k / 100 for k in range(4000)]
    v[300:3500] = [7.77] * 3200  # fills several slices
    o[300:3300] = [5.0] * 3000  # the other side moves at the end only
    df = _readings(spark, v, o).union(_readings(spark, [7.77] * 19, list(map(float, range(19))), source="t").withColumn("id", F.col("id") + 10_000))
    assert {k for k, r in _flags(df).items() if r["stuck"]} == set(range(300, 3500))
    both = _flags(df, stuck={"q": (19, 0)})
    assert {k for k, r in both.items() if r["stuck"]} == {*range(300, 3500), *range(10_000, 10_019)}
    assert not any(r["stuck"] for r in _flags(df, stuck={"z": (2, 0)}).values())


def test_the_fitted_tail_decides(spark, monkeypatch):
    v = walk(900)
    for k in (100, 300, 700):
        v[k] += 40.0
    df = _readings(spark, v)
    assert {k for k, r in _flags(df).items() if r["spike"]} >= {100, 300, 700}
    monkeypatch.setattr("millrace.operators.spikes.tail_cutoff", lambda fit, risk: 1e300)
    assert not any(r["spike"] for r in _flags(df).values())


@pytest.mark.parametrize("shape", [-0.2, 0.1, 0.3])
def test_tail_fit(shape):
    """A known law is found within its standard error, also with spikes beyond it; the cutoff is exceeded as often as the risk says."""
    rng = np.random.default_rng(4)
    excess = (rng.uniform(size=200_000) ** -shape - 1) / shape
    fit = fit_tail(excess, np.ones(len(excess)))
    assert abs(fit[3] - shape) < 4 * fit[4]
    assert 5e-4 < (excess > tail_cutoff(fit, 1e-3)).mean() < 2e-3
    level = np.concatenate([excess, rng.uniform(1e3, 1e6, 600)])
    fit = fit_tail(level, np.ones(len(level)))
    assert abs(fit[3] - shape) < 4 * fit[4] + 0.1
    assert (excess > tail_cutoff(fit, 1e-3)).mean() < 2e-3 and tail_cutoff(fit, 1e-3) < 1e3
    u, tail, scale, xi, error = fit_tail(np.array([1.0, 1.0]), np.array([5.0, 5.0]))
    assert (u, scale) == (1.0, 0.0) and tail_cutoff((u, tail, scale, xi, error), 1e-5) == 1.0


def test_flags_of_empty_constant_and_clashing_tables(spark):
    empty = _readings(spark, [1.0]).limit(0)
    assert _flags(empty) == {}
    assert not any(r["spike"] for r in _flags(_readings(spark, [5.0] * 10)).values())
    clash = _readings(spark, walk(50)).withColumns({"k0": F.lit(1), "t": F.lit(2), "slice": F.lit(3), "I": F.lit(4)})
    assert not any(r["stuck"] or r["changes"] > 25 for r in _flags(clash.drop("I")).values())
    sizes = spark.createDataFrame([("a", k, k, s) for k, s in enumerate([10] * 100 + [401, 400, None, 0, -5])] + [(None, 1, 999, 10_000)], "s string, t long, i long, n long")
    got = flag_magnitudes(sizes, by=["s"], time="t", id="i", value="n")
    assert {r["i"] for r in got.filter("times > 40").collect()} == {100}
    assert flag_magnitudes(sizes.limit(0), by=["s"], time="t", id="i", value="n").count() == 0
