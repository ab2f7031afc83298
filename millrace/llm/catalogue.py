"""Queries and SQL of this subpackage, collected for the driver's entry file."""

from __future__ import annotations

from millrace.llm import queries_text, queries_ticks

QUERIES = {**queries_ticks.QUERIES, **queries_text.QUERIES}
SQL = {**queries_ticks.SQL, **queries_text.SQL}
