"""Edge cases of the frame API and the ordered operators, and the plans they make."""

from datetime import timedelta

import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.context import Engine
from millrace.frame import Frame
from millrace.functions.expr import col
from millrace.functions.sqltext import aliased, split_list
from millrace.operators.patterns import conjuncts
from millrace.operators.stats import gramian
from millrace.operators.patterns import first_match, match_pattern, ruled_out, scan_pattern
from millrace.operators.timejoin import asof_join, hot_span, range_join
from millrace.operators.windows import Hopping, OnCompletion, OnEvent, Session, Sliding, shift, windowed


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_list():
    assert split_list("round(x, 2) as a, concat(b, ',') as c") == ["round(x, 2) as a", "concat(b, ',') as c"]
    assert aliased("a + 1 as b, f(x, '(') AS \"d\"") == [("a + 1", "b"), ("f(x, '(')", "d")]
    with pytest.raises(ValueError):
        aliased("a + 1")
    with pytest.raises(ValueError):
        split_list("f(a")


def test_conjuncts():
    assert conjuncts("a = 1 AND (b = 2 and c = 3) and d between 1 and 2 AND e = ' and '") == ["a = 1", "(b = 2 and c = 3)", "d between 1 and 2", "e = ' and '"]


def test_joins_with_null_keys_and_clashes(spark):
    e = Engine(spark)
    a = e.from_spark(spark.createDataFrame([(1, "x"), (None, "n"), (2, "y")], "k int, v string"))
    b = e.from_spark(spark.createDataFrame([(1, "p"), (None, "q"), (1, "r")], "k int, v string"))
    assert rows(a.join(b, on="k").df) == [(1, "x", "p"), (1, "x", "r")]
    assert a.join(b, on="k").schema == ["k", "v", "v_2"]
    assert rows(a.join(b, on="k", how="left").df) == sorted([(1, "x", "p"), (1, "x", "r"), (2, "y", None), (None, "n", None)], key=repr)
    assert rows(a.join(b, on="k", how="semi").df) == [(1, "x")]
    assert rows(a.join(b, on="k", how="anti").df) == sorted([(2, "y"), (None, "n")], key=repr)
    with pytest.raises(ValueError):
        a.join(b, on="k", how="sideways")
    with pytest.raises(ValueError):
        a.join(b, on="missing")


def test_partitions_and_checked_broadcast(spark):
    e = Engine(spark)
    a = e.from_spark(spark.createDataFrame([(k % 5, k) for k in range(50)], "k int, v int"))
    small = e.from_spark(spark.createDataFrame([(k,) for k in range(5)], "k int"))
    joined = a.join(small, on="k", broadcast_rows=10)
    assert "BroadcastHashJoin" in plan(joined.df) and joined.length() == 50
    p = plan(a.partition("k").groupby("k").agg({"*": "count"}).df)
    assert p.count("Exchange") == 1
    assert a.partition(["k"], n=3, how="range").df.rdd.getNumPartitions() == 3
    with pytest.raises(ValueError):
        a.partition()


def test_checks(spark):
    f = Frame(spark.createDataFrame([(1, None), (2, 5.0)], "a int, b double"))
    with pytest.raises(ValueError):
        f.rename({"a": "b"})
    with pytest.raises(ValueError):
        f.with_columns({"a": col("b")})
    with pytest.raises(ValueError):
        f.groupby("a", orderby=["b"])
    with pytest.raises(ValueError):
        f.ordered_by("a").drop("a")
    assert rows(f.clip({"b": (0.0, 4.0)}).df) == [(1, None), (2, 4.0)]
    assert rows(f.agg({"b": ["avg", "count"], "*": "count"}).df) == [(5.0, 1, 2)]
    assert (f["a"] ** 2 + 1).column is not None


def test_expressions(spark):
    f = Frame(spark.createDataFrame([("Abc", '{"x": "7"}', None)], "s string, j string, n string"))
    got = f.with_columns({"c": col("s").str.contains("b"), "j2": col("j").str.json_extract("x"), "none": col("n").str.to_uppercase(), "t": col("s").str.strptime(), "h": col("s").str.hash()}).collect().iloc[0]
    assert (got.c, got.j2, got.none, got.t) == (True, "7", None, None) or pd.isna(got.t)


def test_asof(spark):
    left = spark.createDataFrame([(1, 10, "a"), (1, 5, "b"), (2, 10, "c"), (None, 10, "d"), (3, None, "e"), (1, 100, "f")], "k int, t long, v string")
    right = spark.createDataFrame([(1, 10, "p", 1), (1, 10, None, 2), (1, 7, "q", 3), (2, 11, "r", 4), (None, 1, "s", 5)], "k int, t long, v string, i int")
    for span in (None, 4, 1000):
        got = asof_join(left, right, left_on="t", right_on="t", left_by="k", right_by="k", tie=["i"], span=span)
        assert got.columns == ["k", "t", "v", "v_2", "i"]
        # of two at one time the last by tie wins, and its null stays null
        assert {r["v"]: (r["v_2"], r["i"]) for r in got.collect()} == {"a": (None, 2), "b": (None, None), "c": (None, None), "d": (None, None), "e": (None, None), "f": (None, 2)}
        got = asof_join(left, right, left_on="t", right_on="t", left_by="k", right_by="k", tie=["i"], direction="forward", span=span)
        assert {r["v"]: r["i"] for r in got.collect()} == {"a": 1, "b": 3, "c": 4, "d": None, "e": None, "f": None}
        got = asof_join(left, right, left_on="t", right_on="t", left_by="k", right_by="k", tie=["i"], tolerance=50, span=span)
        assert {r["v"]: r["i"] for r in got.collect()} == {"a": 2, "b": None, "c": None, "d": None, "e": None, "f": None}
    assert asof_join(left.limit(0), right, left_on="t", right_on="t", left_by="k", right_by="k").count() == 0
    assert asof_join(left, right.limit(0), left_on="t", right_on="t", left_by="k", right_by="k").filter("v_2 is null").count() == 6


def test_range_join_is_an_equi_join(spark):
    left = spark.createDataFrame([(1, t) for t in range(-20, 20)], "k int, t long")
    right = spark.createDataFrame([(1, t) for t in range(-20, 20, 3)], "k int, t long")
    got = range_join(left, right, left_on="t", right_on="t", left_by="k", right_by="k", before=7, after=2)
    want = sorted((a, b) for a in range(-20, 20) for b in range(-20, 20, 3) if a - 7 <= b <= a + 2)
    assert sorted((r["t"], r["t_2"]) for r in got.collect()) == want
    assert "CartesianProduct" not in plan(got) and "NestedLoop" not in plan(got)


def test_windows_at_their_edges(spark):
    df = spark.createDataFrame([(1, 0), (1, 10), (1, 20), (1, 31), (2, 5), (None, 1), (2, None)], "k int, t long")
    s = windowed(df, Session("t", "k", {"n": "count(*)"}, timeout=10), OnCompletion())
    assert rows(s) == [(0, 1, 3), (31, 1, 1), (5, 2, 1)]
    w = windowed(df, Sliding("t", "k", {"n": "count(*)"}, size_before=10), OnEvent())
    assert rows(w) == [(0, 1, 1), (10, 1, 1), (20, 1, 1), (31, 1, 1), (5, 2, 1)]
    w = windowed(df, Sliding("t", "k", {"n": "count(*)"}, size_before=10, closed="both"), OnEvent())
    assert rows(w) == [(0, 1, 1), (10, 1, 2), (20, 1, 2), (31, 1, 1), (5, 2, 1)]
    h = windowed(df.filter("k = 1 and t = 10"), Hopping("t", "k", {"n": "count(*)"}, hop=10, size=25), OnCompletion())
    assert rows(h) == [(-10, 1, 1), (0, 1, 1), (10, 1, 1)]
    with pytest.raises(ValueError):
        windowed(df, Hopping("t", "k", {"n": "count(*)"}, hop=10, size=25), OnEvent())


def test_pattern_needs_rising_time_and_known_events(spark):
    f = Frame(spark.createDataFrame([(1, 1, 5, 0), (1, 1, 9, 1), (1, 2, 9, 2), (2, 3, 10, 3), (1, 50, 99, 4)], "k int, t long, v int, i int")).ordered_by("t")
    got = f.pattern_recognize([("a", "v >= 5"), ("b", "v > a.v")], 10, by="k", id="i")
    assert [(r["a_i"], r["b_i"]) for r in got.df.collect()] == [(0, 2)]
    with pytest.raises(ValueError):
        f.pattern_recognize([("a", "v > b.v"), ("b", "v > 1")], 10, by="k", id="i")


def test_wide_gramian_equals_narrow(spark):
    names = [f"c{i}" for i in range(30)]
    df = spark.range(50).select(*[((F.col("id") * (i + 3)) % 17).alias(c) for i, c in enumerate(names)])
    wide = {r["column"]: r for r in gramian(df, names).collect()}
    narrow = {r["column"]: r for r in gramian(df, names[:5]).collect()}
    assert all(wide[a][b] == narrow[a][b] for a in names[:5] for b in names[:5])


def test_vectors_with_zero_null_and_few_rows(spark):
    a = Frame(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.0])], "i int, e array<double>"))
    p = Frame(spark.createDataFrame([(9, [5.0, 0.0])], "i int, e array<double>"))
    got = a.vector_nn_join(p, "e", k=5)
    assert got.schema == ["i", "e", "i_probe", "e_probe", "similarity", "rank"]
    assert [(r["i"], r["rank"]) for r in got.df.orderBy("rank").collect()] == [(1, 1), (4, 2), (2, 3)]
    assert a.vector_nn_join(Frame(p.df.limit(0)), "e", k=2).length() == 0
    # probe rows that are alike have results of their own; of equal rows the first by the other columns stay
    twice = Frame(p.df.union(p.df))
    assert sorted((r["i"], r["rank"]) for r in a.vector_nn_join(twice, "e", k=2).df.collect()) == [(1, 1), (1, 1), (4, 2), (4, 2)]
    many = Frame(spark.range(500).select(F.col("id").alias("i"), F.array(F.lit(1.0), F.lit(0.0)).alias("e")).repartition(3))
    assert sorted(r["i"] for r in many.vector_nn_join(p, "e", k=3).df.collect()) == [0, 1, 2]


def test_vector_blocks_and_index(spark, monkeypatch):
    monkeypatch.setattr("millrace.operators.vectors.MOST_PROBES", 7)
    monkeypatch.setattr("millrace.operators.vectors.MOST_SIMILARITIES", 60)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 8))
    df = Frame(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "i long, e array<double>").repartition(4))
    probe = Frame(df.df.filter("i % 20 = 0"))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(p, int(i)) for p in range(0, 400, 20) for i in np.argsort(-(unit @ unit[p]), kind="stable")[:6]}
    assert {(r["i_probe"], r["i"]) for r in df.vector_nn_join(probe, "e", k=6).df.collect()} == want
    found = {(r["i_probe"], r["i"]) for r in df.vector_index("e", k=6).search(probe, k=6).df.collect()}
    assert len(found & want) >= 0.9 * len(want)
    assert Frame(df.df.limit(0)).vector_index("e").search(probe, k=2).length() == 0


def test_plans(spark, sf):
    t = Engine(spark).read_parquet(f"{sf}/lineitem.parquet")
    p = plan(t.filter_sql("l_quantity < 3").select(["l_orderkey", "l_quantity"]).df)
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,3.0)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p
    assert "TakeOrderedAndProject" in plan(t.top_k(["l_extendedprice"], 3).df)


def test_timedelta_units(spark):
    df = spark.sql("select 1 as k, timestamp_ntz '2024-01-01 00:10:00' as ts")
    got = windowed(df, Hopping("ts", "k", {"n": "count(*)"}, hop=timedelta(minutes=30), size=timedelta(hours=1)), OnCompletion())
    assert sorted(str(r["ts"]) for r in got.collect()) == ["2023-12-31 23:30:00", "2024-01-01 00:00:00"]


def test_rest_source(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            n = self.path.rsplit("/", 1)[-1]
            self.send_response(404 if n == "3" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"n": int(n), "name": f"x{n}"} if n != "2" else {"n": 2}).encode())

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"result": [{"n": body["n"], "name": "p"}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    e = Engine(spark)
    # a failed call gives no row, a missing field is null
    assert rows(e.read_rest_get(url, [1, 2, 3], "n long, name string", batch_size=2).df) == [(1, "x1"), (2, None)]
    assert rows(e.read_rest_post(url, [{"n": 5}], "n long, name string").df) == [(5, "p")]
    server.shutdown()


def test_hot_keys_are_cut(spark, monkeypatch):
    """With one key that holds half of the rows, every ordered operator gives what it gives in one piece."""
    rng = np.random.default_rng(2)
    n = 900
    key = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcd"), n))
    rows = [(str(k), int(t), i, float(v)) for i, (k, t, v) in enumerate(zip(key, rng.integers(0, 3000, n), rng.normal(size=n)))] + [(None, 5, 9001, 1.0), ("hot", None, 9002, 1.0)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v double").withColumn("p", F.lit(1))
    right = df.filter("i % 3 = 0").drop("p")

    def results():
        how = dict(left_on="t", right_on="t", left_by="k", right_by="k", tie=["i"])
        return [
            sorted(map(repr, x.collect()))
            for x in (
                asof_join(df, right, **how),
                asof_join(df, right, direction="forward", tolerance=40, **how),
                windowed(df, Sliding("t", "k", {"n": "count(*)", "s": "max(v)"}, size_before=25, closed="both"), OnEvent()),
                windowed(df, Session("t", "k", {"n": "count(*)", "s": "max(v)"}, timeout=6), OnCompletion()),
                windowed(df, Session("t", "k", {"n": "count(*)"}, timeout=6), OnEvent()),
                shift(df, ["v"], 2, by="k", order_by="t", tie=("i",)),
                shift(df, ["v"], -40, by="k", order_by="t", fill=0.0, tie=("i",)),
            )
        ]

    whole = results()
    monkeypatch.setattr("millrace.operators.timejoin.MOST_ROWS", 30)
    assert hot_span(df, "k", F.col("t")) is not None
    for a, b in zip(results(), whole):
        assert a == b
    # the pieces of the hot key are alike
    span = hot_span(df, "k", F.col("t"))
    sizes = [r["count"] for r in df.filter("k = 'hot' and t is not null").groupBy((F.col("t") / span).cast("long")).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 3 * np.median(sizes)


def test_join_keeps_the_order_of_a_side(spark):
    a = Frame(spark.createDataFrame([(1, 5), (2, 3)], "k int, t long")).ordered_by("t")
    b = Frame(spark.createDataFrame([(1, 9), (2, 8)], "k int, t long")).ordered_by("t")
    assert a.join(b, on="k", maintain_sort_order="left").time == "t"
    assert a.join(b, on="k", maintain_sort_order="right").time == "t_2"
    with pytest.raises(ValueError):
        a.join(Frame(b.df), on="k", maintain_sort_order="right")


def test_a_scan_holds_one_path(spark):
    """Many candidates for the middle event: one match per start, found without all the paths."""
    rows = [{"__t": k, "__id": k, "v": k % 7} for k in range(200)]
    steps = [lambda r, p: r["v"] > 1, lambda r, p: r["v"] > 2, lambda r, p: r["v"] == 6 and r["__t"] > 20]
    assert first_match(rows, 0, steps, list("abcd"), 10_000) == [0, 2, 3, 27]
    assert first_match(rows, 0, [lambda r, p: False], list("ab"), 50) is None


_SQL_STEPS = [("a", "kind = 'x'"), ("b", "kind = 'y' and v > a.v"), ("c", "kind = 'y' and v <> b.v"), ("d", "kind = 'z' and v < b.v")]
_SCAN_STEPS = [
    ("a", lambda r, p: r["kind"] == "x"),
    ("b", lambda r, p: r["kind"] == "y" and r["v"] > p["a"]["v"]),
    ("c", lambda r, p: r["v"] != p["b"]["v"] and r["kind"] == "y"),
    ("d", lambda r, p: r["kind"] == "z" and r["v"] < p["b"]["v"]),
]


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_a_scan_goes_through_many_keys_at_once(spark, batch):
    """Same matches as in SQL wherever batches end, with equal times, a hot key and spans below zero; not a Python call per key and span."""
    rng = np.random.default_rng(5)
    n = 1_500
    got = [(int(k), int(t), i, str(kind), float(v)) for i, (k, t, kind, v) in enumerate(zip(rng.choice([0, 0, 0, *range(1, 40)], n), rng.integers(-150, 150, n), rng.choice(list("xyz"), n), rng.integers(0, 9, n)))]
    df = spark.createDataFrame([*got, (None, 1, n, "x", 0.0), (1, None, n + 1, "x", 0.0)], "k int, t long, i long, kind string, v double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for upto in (2, 3, 4):
            scan = scan_pattern(df, time="t", by="k", events=_SCAN_STEPS[:upto], span=60, id="i")
            want = match_pattern(df, time="t", by="k", events=_SQL_STEPS[:upto], span=60, id="i")
            assert rows(scan) == rows(want) and scan.count() > 20
            assert "FlatMapGroupsInPandas" not in plan(scan)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_scan_keeps_ids_whole_beside_nulls_and_sees_times(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(1, 1, big, None), (1, 2, big + 2, 5), (1, 3, None, 6)], "k int, s long, i long, v long").withColumn("t", F.timestamp_seconds("s"))
    steps = [("a", lambda r, p: r["s"] == 1 and r["v"] != r["v"]), ("b", lambda r, p: r["t"] - p["a"]["t"] == pd.Timedelta(seconds=1) and r["v"] > 4)]
    got = scan_pattern(df, time="t", by="k", events=steps, span=timedelta(minutes=1), id="i").collect()
    assert [(r["k"], r["a_i"], r["b_i"], r["b_t"].second) for r in got] == [(1, big, big + 2, 2)]
    assert scan_pattern(df.limit(0), time="t", by="k", events=steps, span=timedelta(minutes=1), id="i").count() == 0


def test_a_scan_tries_equal_times_once():
    """Sixty equal rows at each of three times: the first path through them is the answer, the other 3,599 aren't tried."""
    rows, tried = [{"__t": k // 60, "__id": k} for k in range(180)], []
    step = lambda r, p: tried.append(r) is None
    assert first_match(rows, 0, [step, step], list("abc"), 10) == [0, 60, 120] and len(tried) < 200


def test_rows_are_ruled_out_without_earlier_events_only():
    row = {"kind": "x", "v": 1}
    assert ruled_out(lambda r, p: r["kind"] == "y" and r["v"] > p["a"]["v"], row)
    assert not ruled_out(lambda r, p: r["kind"] == "x" and r["v"] > p["a"]["v"], row)
    assert not ruled_out(lambda r, p: r["kind"] == "x", row)
    for look in (lambda p: p["a"], lambda p: p.get("a"), lambda p: "a" in p, lambda p: {**p}, lambda p: len(p), lambda p: bool(p), lambda p: list(p.items()), lambda p: p == {}, lambda p: 1 / 0):
        assert not ruled_out(lambda r, p: look(p) and False, row)

    def hides(r, p):
        try:
            return p["a"]["v"] > r["v"]
        except:  # noqa: E722
            return False

    assert not ruled_out(hides, row)
