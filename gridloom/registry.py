"""Queries by name, and the SQL that an independent engine runs for comparison."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(x: str) -> str:
    return f"CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT)"
