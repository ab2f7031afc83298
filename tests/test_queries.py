"""Every query of the core against its SQL on the smallest tables."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from millrace.plans.compare import rows_of, sql_rows
from millrace.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, sf, name):
    assert rows_of(QUERIES[name](spark, sf)) == sql_rows(con, SQL[name])


@pytest.mark.parametrize("name", ["approx_distinct", "quantile_approximate", "median_approximate", "vector_ann", "p5_flags"])
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_approximate_quantile_is_near(spark, con, sf):
    got = {r["quantile"]: r["l_extendedprice"] for r in QUERIES["quantile_approximate"](spark, sf).collect()}
    for q, v in got.items():
        share = con.execute(f"select avg((l_extendedprice <= {v})::int) from lineitem").fetchall()[0][0]
        assert abs(share - q) < 0.002


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_vector_searches_of_the_whole_table(spark, sf, monkeypatch):
    """Every fiftieth row against all rows, by brute force."""
    monkeypatch.setattr("millrace.operators.vectors.MOST_SIMILARITIES", 70)
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    ids, m = t["vec_id"], np.array(t["embedding"], dtype="float64")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sim = {p: dict(zip(ids, m @ m[k])) for k, p in enumerate(ids) if p % 50 == 0}
    label = dict(zip(ids, t["label"]))

    def nearest(p, n, keep):
        return sorted((i for i in ids if keep(i)), key=lambda i: (-sim[p][i], i))[:n]

    def got(name, *columns):
        return {tuple(r[c] for c in columns) for r in QUERIES[name](spark, sf).collect()}

    assert len(sim) == len(ids) / 50
    assert got("vector_knn", "probe", "vec_id", "rank") == {(p, i, r) for p in sim for r, i in enumerate(nearest(p, 5, lambda i: True), 1)}
    assert got("vector_knn_filtered", "probe", "vec_id", "rank") == {(p, i, r) for p in sim for r, i in enumerate(nearest(p, 3, lambda i: label[i] == 3), 1)}
    assert got("vector_knn_left", "vec_id", "nearest") == {(p, nearest(p, 1, lambda i: i != p)[0]) for p in sim}
    assert got("vector_range", "probe", "vec_id") == {(p, i) for p in sim for i in ids if i != p and sim[p][i] >= 0.3}


def test_index_finds_nine_in_ten(spark, sf):
    r = QUERIES["vector_ann_recall"](spark, sf.replace("sf0.001", "sf0.01")).first()
    assert r["searches"] == 10 and r["recall_held"]
