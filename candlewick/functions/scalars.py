"""Scalar functions whose rules differ from Spark's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Round, halves towards plus infinity."""
    f = F.lit(float(10**digits))
    return F.floor(x * f + 0.5) / f


def concat_text(*parts: Column) -> Column:
    """`||`: null parts count as empty."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def natural_log(x: Column) -> Column:
    """LN and one-argument LOG; null where x <= 0."""
    return F.ln(x)


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def remainder(a: Column, b: Column) -> Column:
    """a % b with the dividend's sign, null where b is 0."""
    return F.try_mod(a, b)


def matches(x: Column, pattern: str) -> Column:
    """LIKE, whatever the case."""
    return x.ilike(pattern)


def finite(x: Column) -> Column:
    """x, or null where it is not a finite number: aggregates skip those."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def hash_bucket(key: Column, buckets: int) -> Column:
    """Bucket of a key by Spark's hash."""
    return F.pmod(F.hash(key), F.lit(buckets))


def polynomial_hash(text: Column) -> Column:
    """Absolute 32-bit value of h = 31 h + code unit over a text's characters (of the basic plane)."""
    wrap = lambda v: F.pmod(v + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    units = F.filter(F.split(text, ""), lambda c: c != "")
    return F.abs(F.aggregate(units, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + F.ascii(c)))).cast("long")


def time_label(ms: Column, unit: str = "day") -> Column:
    """UTC label of epoch milliseconds: a prefix of the ISO date."""
    pattern = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit]
    return F.date_format(F.timestamp_millis(ms), pattern)


def range_label(x: Column, ranges: Sequence[tuple[float, float, str]], default: str = "default") -> Column:
    """Label of the first half-open range that holds x."""
    out = F.lit(default)
    for low, high, label in reversed(ranges):
        out = F.when((x >= low) & (x < high), F.lit(label)).otherwise(out)
    return out


#: Quote currencies of crypto pairs, and the tickers that count as major US shares.
CRYPTO_QUOTES = ("USDT", "BUSD", "USDC")
US_MAJORS = (
    "AAPL", "MSFT", "GOOGL", "AMZN", "META", "TSLA", "NVDA", "BRK.B", "JPM", "V", "WMT", "PG", "MA", "HD", "DIS", "BAC", "NFLX", "ADBE", "CRM", "CSCO",
    "PEP", "KO", "INTC", "AMD", "PYPL", "CMCSA", "TMO",
)


def asset_class(base: Column, quote: Column) -> Column:
    """Which kind of source an instrument belongs to, by quote currency; Hong Kong and Chinese shares have numbers as
    tickers, US shares are major or not by their ticker without digits; anything else is unknown."""
    number = base.rlike("^[0-9]+$")
    major = F.regexp_replace(base, "[0-9]+", "").isin(*US_MAJORS)
    return (
        F.when(quote.isin(*CRYPTO_QUOTES), "crypto")
        .when((quote == "HKD") & number, "hk_stock")
        .when(quote.isin("CNY", "CNH") & number, "cn_stock")
        .when(quote == "USD", F.when(major, "us_major").otherwise("us_stock"))
        .otherwise("unknown")
    )
