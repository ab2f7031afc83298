"""Queries by name, one module per family, each with the SQL it is held against."""

from __future__ import annotations

from millrace.queries import analytics, inputs, relational, scalars, ticks, timeseries

_FAMILIES = (ticks, relational, scalars, timeseries, analytics, inputs)

QUERIES = {k: v for m in _FAMILIES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _FAMILIES for k, v in m.SQL.items()}
