"""Hold a query's rows against the same query in SQL (used by tests)."""

from __future__ import annotations

import math
from pathlib import Path


def normal(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else round(value, 9))
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if hasattr(value, "isoformat"):
        return str(value)
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def rows_of(df) -> tuple[list[str], list[tuple]]:
    """Column names sorted, rows with columns in that order, sorted."""
    cols = sorted(df.columns)
    rows = [tuple(normal(v) for v in r) for r in df.select(*cols).collect()]
    return cols, sorted(rows, key=repr)


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(normal(r[i]) for i in order) for r in cur.fetchall()]
    return [names[i] for i in order], sorted(rows, key=repr)


def connect(sf_dir: str):
    """DuckDB with each Parquet table of ``sf_dir`` as a view."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{src}')")
    return con
