"""Registry of queries and of the SQL that says what they should return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(columns: str, rows: list[tuple]) -> str:
    """SQL for hand-written rows. None is null; other values are cast by the column list, "name TYPE, ..."."""
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"
    parts = [c.strip().split(" ", 1) for c in columns.split(",")]
    names = ", ".join(n for n, _ in parts)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in parts)
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"
