"""A query's Spark plan and its SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that DuckDB runs on the same tables."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


#: Ticks in SQL: symbol, user_id, id, ts in ms, price.
TICKS = "(SELECT event_type AS symbol, user_id, event_id AS id, epoch_us(ts) // 1000 AS ts, value AS price FROM events)"
#: Hourly bars in SQL.
HOURLY = f"(SELECT symbol, (ts // 3600000) * 3600000 AS bucket, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, count(*) AS volume FROM {TICKS} GROUP BY ALL)"


def r(x: str, digits: int = 4) -> str:
    """Rounding in SQL, halves up, as functions.scalars.round_half_up does."""
    f = float(10**digits)
    return f"floor(({x}) * {f} + 0.5) / {f}"
