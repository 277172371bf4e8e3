"""Row types of market data, and bar intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "double": T.DoubleType()}


def struct_type(fields: str) -> T.StructType:
    """A schema from `name type, ...`, without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(","))])


KLINE = struct_type("symbol string, exchange string, base_currency string, quote_currency string, interval string, timestamp long, open double, high double, low double, close double, volume double, quote_volume double, trades int, taker_buy_volume double, taker_buy_quote_volume double")
TICK = struct_type("symbol string, timestamp long, price double, volume int")
TRADE = struct_type("trade_id long, order_id long, symbol_id int, side short, qty double, price double, fee double, pnl double, timestamp long")
EQUITY = struct_type("timestamp long, total_equity double, available_balance double, position_value double, unrealised_pnl double")

#: Seconds of a bar interval; a week is 7 days, a month 30.
INTERVALS = {"1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "6h": 21600, "8h": 28800, "12h": 43200, "1d": 86400, "3d": 259200, "1w": 604800, "1M": 2592000}
#: Types of table definitions and what they are here.
SQL_TYPES = {"BIGINT": "long", "LONG": "long", "TIMESTAMP": "long", "INT": "int", "INTEGER": "int", "SMALLINT": "short", "SHORT": "short", "FLOAT": "double", "DOUBLE": "double", "REAL": "double", "DECIMAL": "double", "NUMERIC": "double", "STRING": "string", "VARCHAR": "string"}


def interval_seconds(interval: str | Column) -> Column:
    """Seconds of an interval's name; null for an unknown one."""
    if isinstance(interval, str):
        return F.lit(INTERVALS.get(interval))
    return F.coalesce(*[F.when(interval == k, F.lit(v)) for k, v in INTERVALS.items()])


def bars_between(start: Column, end: Column, seconds: int) -> Column:
    """Bars that cover [start, end), both in seconds; a part counts as one."""
    return F.ceil((end - start) / F.lit(seconds))


def canonical_interval(minutes: Column) -> Column:
    """The name of an interval of so many minutes, where there is one; else minutes and `m`."""
    names = {v // 60: k for k, v in INTERVALS.items()}
    return F.coalesce(*[F.when(minutes == k, F.lit(v)) for k, v in names.items()], F.concat(minutes.cast("string"), F.lit("m")))


def canonical(interval: str) -> str:
    """The usual name of an interval that may be given in minutes (`60m`, `1440`)."""
    if interval in INTERVALS:
        return interval
    minutes = interval.removesuffix("m")
    if not minutes.isdigit():
        raise ValueError(f"unknown interval: {interval}")
    return {v // 60: k for k, v in INTERVALS.items()}.get(int(minutes), f"{int(minutes)}m")


def seconds_of(interval: str) -> int:
    """Seconds of an interval: a name of INTERVALS, or a number and s, m, h, d or w."""
    if interval in INTERVALS:
        return INTERVALS[interval]
    unit = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}.get(interval[-1:])
    if unit is None or not interval[:-1].isdigit() or int(interval[:-1]) < 1:
        raise ValueError(f"unknown interval: {interval}")
    return int(interval[:-1]) * unit


def schema_of(columns: list[tuple[str, str]]) -> T.StructType:
    """The schema of a table definition; unknown types raise."""
    unknown = [t for _, t in columns if t.upper() not in SQL_TYPES]
    if unknown:
        raise ValueError(f"unknown types: {unknown}")
    return T.StructType([T.StructField(c, _TYPES[SQL_TYPES[t.upper()]]) for c, t in columns])
