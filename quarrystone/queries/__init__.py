"""Registered queries and the SQL they are held against."""

from __future__ import annotations

from quarrystone.queries import analytics, general, profiling, records

MODULES = [general, profiling, analytics, records]


def all_queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
