"""Time series, indicators, backtests and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import backtest as B
from ..operators import indicators as I
from ..operators import timeseries as T
from ..schema import INTERVALS, bars_between, canonical_interval
from ..sources.tables import HOUR, hourly, table, ticks
from .registry import HOURLY, TICKS, query, r

R = S.round_half_up
DAY = 24 * HOUR
AT = 1705312800000  # 2024-01-15 10:00 UTC
SYMBOLS = ("click", "view", "purchase", "signup", "error", "login", "logout", "scroll", "search", "add_to_cart")


# -- time series -----------------------------------------------------------------------------


@query(f"SELECT symbol, bucket, open, high, low, close, volume FROM {HOURLY}")
def ohlcv(spark, d):
    return hourly(spark, d)


@query(f"SELECT symbol, (ts // {DAY}) * {DAY} AS bucket, arg_min(price, ts) AS price_first, arg_max(price, ts) AS price_last, min(price) AS price_min, max(price) AS price_max, {r('sum(price)', 3)} AS price_sum, count(price) AS price_count, {r('avg(price)')} AS price_avg FROM {TICKS} GROUP BY ALL")
def sample_by(spark, d):
    out = T.sample_by(ticks(spark, d), "ts", DAY, {"price": ["first", "last", "min", "max", "sum", "count", "avg"]}, ["symbol"], ["id"])
    return out.withColumns({"price_sum": R(F.col("price_sum"), 3), "price_avg": R(F.col("price_avg"), 4)})


@query(f"SELECT symbol, bar, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, count(*) AS volume FROM (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, id) - 1) // 50 AS bar FROM {TICKS}) GROUP BY symbol, bar")
def ohlcv_count_bucket(spark, d):
    return T.count_ohlcv(ticks(spark, d).withColumn("one", F.lit(1)), "ts", "price", "one", 50, ["symbol"], ["id"])


@query(f"SELECT user_id, max(ts) AS ts, arg_max(price, ts) AS price, arg_max(symbol, ts) AS symbol FROM {TICKS} GROUP BY user_id")
def latest_on(spark, d):
    return T.latest_on(ticks(spark, d), ["user_id"], "ts", ["price", "symbol"], ["id"])


@query(f"SELECT symbol, id, ts, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, id DESC) AS rn FROM {TICKS}) WHERE rn <= 20")
def last_n_bars(spark, d):
    return T.last_n(ticks(spark, d), ["symbol"], "ts", 20, ["id"]).select("symbol", "id", "ts", "price")


@query(f"SELECT id, ts, price FROM {TICKS} WHERE symbol = 'click' AND ts BETWEEN {AT} AND {AT + DAY} ORDER BY ts, id LIMIT 500")
def range_query(spark, d):
    t = ticks(spark, d)
    return t.where((t.symbol == "click") & t.ts.between(AT, AT + DAY)).orderBy("ts", "id").limit(500).select("id", "ts", "price")


@query(f"SELECT id, ts FROM {TICKS} ORDER BY ts DESC, id DESC LIMIT 25")
def reverse_limit(spark, d):
    return ticks(spark, d).orderBy(F.desc("ts"), F.desc("id")).limit(25).select("id", "ts")


@query(f"SELECT symbol, coalesce(arg_max(price, ts) FILTER (ts <= {AT}), 0.0) AS price FROM {TICKS} GROUP BY symbol")
def asof_snapshot(spark, d):
    return T.asof_snapshot(ticks(spark, d), ["symbol"], "ts", AT, ["price"], ["id"])


_CELLS = f"(SELECT symbol, (ts // {6 * HOUR}) * {6 * HOUR} AS ts, arg_max(price, ts) AS price FROM {TICKS} WHERE symbol IN {SYMBOLS} GROUP BY ALL)"


@query(f"WITH c AS {_CELLS}, g AS (SELECT DISTINCT ts FROM c), s AS (SELECT unnest({list(SYMBOLS)}) AS symbol) SELECT s.symbol, g.ts, coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY g.ts ROWS UNBOUNDED PRECEDING), 0.0) AS price FROM g CROSS JOIN s LEFT JOIN c ON c.ts = g.ts AND c.symbol = s.symbol")
def snapshot_series(spark, d):
    cells = ticks(spark, d).withColumns({"at": F.col("ts"), "ts": T.bucket("ts", 6 * HOUR)})
    return T.snapshot_series(cells.select("symbol", "ts", "at", "price", "id"), "symbol", SYMBOLS, "ts", ["price"], ["at", "id"])


_A, _B = f"(SELECT * FROM {TICKS} WHERE symbol = 'purchase')", f"(SELECT user_id, ts, price AS quote FROM {TICKS} WHERE symbol = 'view')"


@query(f"SELECT a.id, a.user_id, a.ts, a.price, b.quote FROM {_A} a ASOF LEFT JOIN {_B} b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_pairwise(spark, d):
    t = ticks(spark, d)
    left = t.where("symbol = 'purchase'").select("id", "user_id", "ts", "price")
    right = t.where("symbol = 'view'").select("user_id", "ts", F.col("price").alias("quote"), F.col("id").alias("rid"))
    return T.asof_pairwise(left, right, ["user_id"], "ts", ["quote"], ["rid"])


@query(f"SELECT user_id, ts, price FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(ts - {AT}), ts DESC, id DESC) AS rn FROM {TICKS}) WHERE rn = 1")
def nearest_ts(spark, d):
    return T.nearest(ticks(spark, d), ["user_id"], "ts", AT, ["price"], ["id"])


@query(f"SELECT id, symbol, ts, price FROM {TICKS} WHERE ts BETWEEN {AT} AND {AT + 3 * DAY} ORDER BY ts, symbol, id")
def replay_ordered(spark, d):
    return T.replay(ticks(spark, d), "ts", ["symbol", "id"], AT, AT + 3 * DAY).select("id", "symbol", "ts", "price")


_SHIP = "(SELECT l_suppkey, epoch_ms(l_shipdate) AS ts, l_orderkey, l_linenumber, l_quantity FROM lineitem)"


@query(f"SELECT DISTINCT l_suppkey, ts FROM {_SHIP}")
def snapshot_boundaries(spark, d):
    ship = table(spark, d, "lineitem").select("l_suppkey", F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts"), "l_orderkey", "l_linenumber")
    return T.boundaries(ship, "ts", ["l_suppkey"], ["l_orderkey", "l_linenumber"]).select("l_suppkey", "ts")


@query(f"SELECT symbol, t.target, count(*) FILTER (ts < t.target) AS position FROM {TICKS}, (SELECT unnest([{AT}, {AT + DAY}, {AT + 5 * DAY}]) AS target) t GROUP BY symbol, t.target")
def lower_bound_batch(spark, d):
    return T.lower_bounds(ticks(spark, d), ["symbol"], "ts", [AT, AT + DAY, AT + 5 * DAY])


@query(f"SELECT symbol, row_number() OVER (ORDER BY f, i) - 1 AS code FROM (SELECT symbol, min(ts) AS f, arg_min(id, ts) AS i FROM {TICKS} GROUP BY symbol)")
def symbol_encode(spark, d):
    return T.symbol_codes(ticks(spark, d), "symbol", ["ts", "id"])


@query(f"WITH c AS (SELECT symbol, row_number() OVER (ORDER BY f) - 1 AS code FROM (SELECT symbol, min(ts) AS f FROM {TICKS} GROUP BY symbol)) SELECT t.id, c.code, c.symbol FROM {TICKS} t JOIN c ON t.symbol = c.symbol")
def symbol_decode(spark, d):
    t = ticks(spark, d)
    codes = T.symbol_codes(t, "symbol", ["ts", "id"])
    coded = t.join(codes, "symbol").select("id", "code")
    return coded.join(codes, "code").select("id", "code", "symbol")


_NAMES = " ".join(f"WHEN {v // 60} THEN '{k}'" for k, v in INTERVALS.items())


@query(f"SELECT o_orderkey, CAST(ceil(o_totalprice / 3600.0) AS BIGINT) AS bars, CASE minutes {_NAMES} ELSE minutes || 'm' END AS name FROM (SELECT *, (o_custkey % 60 + 1) * (o_orderkey % 24 + 1) AS minutes FROM orders)")
def interval_math(spark, d):
    minutes = (F.col("o_custkey") % 60 + 1) * (F.col("o_orderkey") % 24 + 1)
    return table(spark, d, "orders").select("o_orderkey", bars_between(F.lit(0.0), F.col("o_totalprice"), INTERVALS["1h"]).alias("bars"), canonical_interval(minutes).alias("name"))


@query(f"SELECT symbol, (ts // 14400000) * 14400000 AS bucket, arg_min(price, ts) AS price_first, {r('avg(price)')} AS price_avg FROM {TICKS} GROUP BY ALL")
def sample_by_interval(spark, d):
    return T.sample_by_interval(ticks(spark, d), "ts", "4h", {"price": ["first", "avg"]}, ["symbol"], ["id"]).withColumn("price_avg", R(F.col("price_avg"), 4))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y') AS year FROM events")
def partition_label_time(spark, d):
    return ticks(spark, d).select(F.col("id").alias("event_id"), *[S.time_label(F.col("ts"), u).alias(u) for u in ("day", "month", "year")])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 'low' WHEN l_quantity >= 10 AND l_quantity < 30 THEN 'mid' ELSE 'default' END AS label FROM lineitem")
def partition_label_range(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.range_label(F.col("l_quantity"), [(0, 10, "low"), (10, 30, "mid")]).alias("label"))


_PAIR = "(SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 3 = 1 THEN upper(substr(c_mktsegment, 1, 4)) ELSE ['AAPL', 'V', 'ZZTOP', 'BRK.B', 'KO7'][c_custkey % 5 + 1] END AS base, ['USDT', 'USD', 'HKD', 'CNY', 'CNH', 'CHF', 'USDC'][c_nationkey % 7 + 1] AS quote FROM customer)"
_MAJORS = ", ".join(f"'{t}'" for t in S.US_MAJORS)


@query(f"SELECT c_custkey, CASE WHEN quote IN ('USDT', 'BUSD', 'USDC') THEN 'crypto' WHEN quote = 'HKD' AND regexp_full_match(base, '[0-9]+') THEN 'hk_stock' WHEN quote IN ('CNY', 'CNH') AND regexp_full_match(base, '[0-9]+') THEN 'cn_stock' WHEN quote = 'USD' AND regexp_replace(base, '[0-9]+', '', 'g') IN ({_MAJORS}) THEN 'us_major' WHEN quote = 'USD' THEN 'us_stock' ELSE 'unknown' END AS kind FROM {_PAIR}")
def asset_class_route(spark, d):
    key, pick = F.col("c_custkey"), lambda at, *v: F.element_at(F.array(*map(F.lit, v)), (at + 1).cast("int"))
    base = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, F.upper(F.substring("c_mktsegment", 1, 4))).otherwise(pick(key % 5, "AAPL", "V", "ZZTOP", "BRK.B", "KO7"))
    quote = pick(F.col("c_nationkey") % 7, "USDT", "USD", "HKD", "CNY", "CNH", "CHF", "USDC")
    return table(spark, d, "customer").select("c_custkey", S.asset_class(base, quote).alias("kind"))


@query("SELECT c_custkey, abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda x: ascii(x)::BIGINT)), lambda h, c: (((h * 31 + c + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648)) AS h FROM customer")
def string_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.polynomial_hash(F.col("c_name")).alias("h"))


# -- indicators ------------------------------------------------------------------------------

_K, _O = ["symbol"], ["bucket"]


def _w():
    return I.over(_K, _O)


_ROWS = "OVER (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_RN = "row_number() OVER (PARTITION BY symbol ORDER BY bucket)"
_LAG = "lag({}, {}) OVER (PARTITION BY symbol ORDER BY bucket)"


def _bars(spark, d, **columns):
    return hourly(spark, d).select("symbol", "bucket", *[v.alias(k) for k, v in columns.items()])


def _sql(**columns):
    return "SELECT symbol, bucket, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM {HOURLY}"


_AVG20, _STD20 = f"avg(close) {_ROWS.format(19)}", f"stddev_pop(close) {_ROWS.format(19)}"


@query(_sql(x=r(f"CASE WHEN {_RN} >= 20 THEN {_AVG20} END", 6)))
def sma(spark, d):
    return _bars(spark, d, x=R(I.sma("close", 20, _w()), 6))


@query(_sql(x=r(_AVG20, 6)))
def sma_partial(spark, d):
    return _bars(spark, d, x=R(I.sma_partial("close", 20, _w()), 6))


@query(_sql(x=r(f"CASE WHEN {_RN} >= 20 THEN {_STD20} ELSE 0 END", 6)))
def rolling_std_pop(spark, d):
    return _bars(spark, d, x=R(I.rolling_std("close", 20, _w(), True), 6))


@query(_sql(x=r(f"CASE WHEN {_RN} >= 20 THEN {_STD20} END", 6)))
def rolling_std_nullwarm(spark, d):
    return _bars(spark, d, x=R(I.rolling_std("close", 20, _w()), 6))


@query(_sql(upper=r(f"CASE WHEN {_RN} >= 20 THEN {_AVG20} + 2 * {_STD20} END", 6), middle=r(f"CASE WHEN {_RN} >= 20 THEN {_AVG20} END", 6), lower=r(f"CASE WHEN {_RN} >= 20 THEN {_AVG20} - 2 * {_STD20} END", 6)))
def bollinger(spark, d):
    out = hourly(spark, d).select("symbol", "bucket", *I.bollinger("close", 20, 2, _w()))
    return out.withColumns({c: R(F.col(c), 6) for c in ("upper", "middle", "lower")})


@query(f"SELECT symbol, bucket, CAST(sum(v) {_ROWS.format('UNBOUNDED')} AS BIGINT) AS obv FROM (SELECT *, CASE WHEN {_LAG.format('close', 1)} IS NULL THEN volume WHEN close > {_LAG.format('close', 1)} THEN volume WHEN close < {_LAG.format('close', 1)} THEN -volume ELSE 0 END AS v FROM {HOURLY})")
def obv(spark, d):
    signed = hourly(spark, d).withColumn("v", I.obv("close", "volume", _w()))
    return signed.select("symbol", "bucket", F.sum("v").over(_w().rowsBetween(Window.unboundedPreceding, 0)).alias("obv"))


@query(_sql(x=r(f"CASE WHEN {_RN} >= 5 THEN (close * 5 + {_LAG.format('close', 1)} * 4 + {_LAG.format('close', 2)} * 3 + {_LAG.format('close', 3)} * 2 + {_LAG.format('close', 4)}) / 15 END", 6)))
def wma(spark, d):
    return _bars(spark, d, x=R(I.wma("close", 5, _w()), 6))


@query(_sql(x=r(f"close - {_LAG.format('close', 10)}", 6)))
def momentum(spark, d):
    return _bars(spark, d, x=R(I.momentum("close", 10, _w()), 6))


@query(_sql(x=r(f"100 * (close - {_LAG.format('close', 10)}) / nullif({_LAG.format('close', 10)}, 0)", 6)))
def roc(spark, d):
    return _bars(spark, d, x=R(I.roc("close", 10, _w()), 6))


@query(_sql(x=f"CAST(sum(volume) {_ROWS.format('UNBOUNDED')} AS BIGINT)"))
def prefix_sum(spark, d):
    return _bars(spark, d, x=I.prefix_sum("volume", _w()))


@query(_sql(x=f"volume - coalesce({_LAG.format('volume', 1)}, 0)"))
def delta_encode(spark, d):
    return _bars(spark, d, x=I.delta_encode("volume", _w()))


@query(_sql(x="volume"))
def delta_decode(spark, d):
    coded = hourly(spark, d).withColumn("delta", I.delta_encode("volume", _w()))
    return coded.select("symbol", "bucket", I.prefix_sum("delta", _w()).alias("x"))


_N = f"n AS (SELECT symbol, bucket, close, high, low, {_RN} AS i FROM {HOURLY})"


def _ema_sql(n: int, seed: bool, x: str = "close", source: str = "n", name: str = "e") -> str:
    """A recursive table `name` (symbol, i, y) over source (symbol, i, x)."""
    a = 2 / (n + 1)
    start = f"SELECT symbol, {n}::BIGINT AS i, avg({x}) AS y FROM {source} WHERE i <= {n} GROUP BY symbol HAVING count(*) >= {n}" if seed else f"SELECT symbol, i, {x} AS y FROM {source} WHERE i = 1"
    return f"{name} AS ({start} UNION ALL SELECT s.symbol, s.i, {a!r} * s.{x} + {1 - a!r} * p.y FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.i = p.i + 1)"


@query(f"WITH RECURSIVE {_N}, {_ema_sql(10, False)} SELECT n.symbol, n.bucket, {r('e.y', 6)} AS ema FROM n LEFT JOIN e ON n.symbol = e.symbol AND n.i = e.i")
def ema_seed_first(spark, d):
    return I.ema(hourly(spark, d), _K, _O, "close", 10, False).select("symbol", "bucket", R(F.col("ema"), 6).alias("ema"))


@query(f"WITH RECURSIVE {_N}, {_ema_sql(10, False)} SELECT n.symbol, n.bucket, {r('e.y', 6)} AS ema FROM n LEFT JOIN e ON n.symbol = e.symbol AND n.i = e.i")
def ema_chunked(spark, d):
    return I.ema_in_chunks(hourly(spark, d), _K, _O, "close", 10, 100).select("symbol", "bucket", R(F.col("ema"), 6).alias("ema"))


@query(f"WITH RECURSIVE {_N}, {_ema_sql(10, True)} SELECT n.symbol, n.bucket, {r('e.y', 6)} AS ema FROM n LEFT JOIN e ON n.symbol = e.symbol AND n.i = e.i")
def ema_seed_sma(spark, d):
    return I.ema(hourly(spark, d), _K, _O, "close", 10, True).select("symbol", "bucket", R(F.col("ema"), 6).alias("ema"))


@query(
    f"WITH RECURSIVE {_N}, {_ema_sql(12, True, name='f')}, {_ema_sql(26, True, name='s')}, m AS (SELECT s.symbol, s.i AS k, s.i - 25 AS i, f.y - s.y AS line FROM s JOIN f ON f.symbol = s.symbol AND f.i = s.i), {_ema_sql(9, True, 'line', 'm', 'g')}"
    f" SELECT n.symbol, n.bucket, {r('m.line', 6)} AS macd, {r('g.y', 6)} AS signal, {r('m.line - g.y', 6)} AS histogram FROM n LEFT JOIN m ON n.symbol = m.symbol AND n.i = m.k LEFT JOIN g ON g.symbol = m.symbol AND g.i = m.i"
)
def macd(spark, d):
    out = I.macd(hourly(spark, d), _K, _O, "close")
    return out.select("symbol", "bucket", *[R(F.col(c), 6).alias(c) for c in ("macd", "signal", "histogram")])


def _wilder_sql(n: int, x: str, source: str, name: str) -> str:
    return f"{name} AS (SELECT symbol, {n + 1}::BIGINT AS i, avg({x}) AS y FROM {source} WHERE i BETWEEN 2 AND {n + 1} GROUP BY symbol HAVING count(*) >= {n} UNION ALL SELECT s.symbol, s.i, (p.y * {n - 1} + s.{x}) / {n} FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.i = p.i + 1)"


_DIFF = "x AS (SELECT symbol, bucket, i, greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS down, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS t FROM n WINDOW w AS (PARTITION BY symbol ORDER BY i))"


@query(f"WITH RECURSIVE {_N}, {_DIFF}, {_wilder_sql(14, 'up', 'x', 'g')}, {_wilder_sql(14, 'down', 'x', 'l')} SELECT x.symbol, x.bucket, {r('100 - 100 / (1 + CASE WHEN l.y = 0 THEN 100 ELSE g.y / l.y END)', 6)} AS rsi FROM x LEFT JOIN g ON g.symbol = x.symbol AND g.i = x.i LEFT JOIN l ON l.symbol = x.symbol AND l.i = x.i")
def rsi(spark, d):
    return I.rsi(hourly(spark, d), _K, _O, "close").select("symbol", "bucket", R(F.col("rsi"), 6).alias("rsi"))


@query(f"WITH RECURSIVE {_N}, {_DIFF}, {_wilder_sql(14, 't', 'x', 'a')} SELECT x.symbol, x.bucket, {r('a.y', 6)} AS atr FROM x LEFT JOIN a ON a.symbol = x.symbol AND a.i = x.i")
def atr(spark, d):
    return I.atr(hourly(spark, d), _K, _O, "high", "low", "close").select("symbol", "bucket", R(F.col("atr"), 6).alias("atr"))


# -- backtests -------------------------------------------------------------------------------

_EQ = f"(SELECT symbol, bucket, 1000 + sum(close) {_ROWS.format('UNBOUNDED')} AS equity FROM {HOURLY})"


def _equity(spark, d):
    return hourly(spark, d).select("symbol", "bucket", (1000 + F.sum("close").over(_w().rowsBetween(Window.unboundedPreceding, 0))).alias("equity"))


@query(f"SELECT symbol, bucket, {r('equity', 2)} AS equity, {r('peak', 2)} AS peak, {r('(peak - equity) / peak')} AS drawdown FROM (SELECT *, max(equity) {_ROWS.format('UNBOUNDED')} AS peak FROM {_EQ})")
def equity_drawdown(spark, d):
    out = B.drawdown(_equity(spark, d), _K, "bucket", "equity")
    return out.select("symbol", "bucket", R(F.col("equity"), 2).alias("equity"), R(F.col("peak"), 2).alias("peak"), R(F.col("drawdown"), 4).alias("drawdown"))


@query(f"WITH e AS {_EQ}, x AS (SELECT *, coalesce(equity / {_LAG.format('equity', 1)} - 1, 0) AS ret, max(equity) {_ROWS.format('UNBOUNDED')} AS peak FROM e) SELECT symbol, {r('arg_max(equity, bucket) / arg_min(equity, bucket) - 1')} AS total_return, {r('max((peak - equity) / peak)')} AS max_drawdown, {r('avg(ret) / stddev_pop(ret)')} AS sharpe, count(*) AS n_bars FROM x GROUP BY symbol")
def backtest_metrics(spark, d):
    out = B.metrics(_equity(spark, d), _K, "bucket", "equity")
    return out.select("symbol", *[R(F.col(c), 4).alias(c) for c in ("total_return", "max_drawdown", "sharpe")], "n_bars")


@query(f"WITH a AS (SELECT symbol, bucket, CASE WHEN {_RN} >= 20 THEN avg(close) {_ROWS.format(4)} > avg(close) {_ROWS.format(19)} END AS above FROM {HOURLY}), b AS (SELECT *, lag(above) OVER (PARTITION BY symbol ORDER BY bucket) AS was FROM a) SELECT symbol, bucket, CASE WHEN above THEN 1 ELSE -1 END AS signal FROM b WHERE was IS NOT NULL AND above <> was")
def ma_cross_signals(spark, d):
    return B.cross_signals(hourly(spark, d), _K, "bucket", "close").select("symbol", "bucket", "signal")


_LIMITS = f"(SELECT id, symbol, CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END AS side, ts AS placed, CASE WHEN id % 2 = 0 THEN price * 0.9 ELSE price * 1.1 END AS lim, ts + {DAY} AS until FROM {TICKS})"


@query(f"SELECT o.id, min(t.ts) AS filled FROM {_LIMITS} o JOIN {TICKS} t ON o.symbol = t.symbol AND t.ts > o.placed AND t.ts <= o.until AND ((side = 1 AND t.price <= lim) OR (side = -1 AND t.price >= lim)) GROUP BY o.id")
def limit_fill_first_touch(spark, d):
    t = ticks(spark, d)
    even = F.col("id") % 2 == 0
    orders = t.select("id", "symbol", F.when(even, 1).otherwise(-1).alias("side"), F.col("ts").alias("placed"), F.when(even, F.col("price") * 0.9).otherwise(F.col("price") * 1.1).alias("limit"), (F.col("ts") + DAY).alias("until"))
    return B.first_touch(orders, t.select("symbol", "ts", "price"), "symbol", "ts", "price", 4 * HOUR)


@query(f"SELECT symbol, l.level, {r('close * (1 + l.level * 0.01)')} AS price FROM (SELECT symbol, arg_max(close, bucket) AS close FROM {HOURLY} GROUP BY symbol), (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS level) l")
def grid_levels(spark, d):
    last = T.latest_on(hourly(spark, d), ["symbol"], "bucket", ["close"])
    return B.grid_levels(last.select("symbol", "close"), "close", 3, 0.01).select("symbol", "level", R(F.col("price"), 4).alias("price"))


@query(f"SELECT symbol, min(bucket) AS stopped FROM (SELECT symbol, bucket, 1000 + close - arg_min(close, bucket) OVER (PARTITION BY symbol) AS equity FROM {HOURLY}) WHERE (1000 - equity) / 1000 > 0.02 GROUP BY symbol")
def risk_stop(spark, d):
    first = F.min_by("close", "bucket").over(Window.partitionBy("symbol"))
    return B.first_breach(hourly(spark, d).select("symbol", "bucket", (1000 + F.col("close") - first).alias("equity")), _K, "bucket", "equity", 1000, 0.02)


def _for_runs(spark, d):
    # prices are lifted, as a ledger needs them above zero
    return hourly(spark, d).select("symbol", F.col("bucket").alias("ts"), (F.abs("close") + 1).alias("close")).withColumn("run", F.col("symbol"))


@query()
def backtest_run(spark, d):
    equity = B.simulate(_for_runs(spark, d), ["run"], B.MovingAverageCross)
    return B.metrics(equity, ["run"]).join(B.trade_metrics(equity, ["run"]), "run")


@query()
def backtest_grid(spark, d):
    return B.trade_metrics(B.simulate(_for_runs(spark, d), ["run"], B.Grid), ["run"])


@query()
def param_sweep(spark, d):
    sets = [{"fast": f, "slow": s} for f in (3, 5) for s in (10, 20)]
    return B.sweep(_for_runs(spark, d), ["run"], B.MovingAverageCross, sets).drop("seconds")


def _scenario_sql(name: str) -> str:
    """The phases in closed form."""
    parts, at, level = [], 0, 100.0
    for i, (kind, seconds, size) in enumerate(B.SCENARIOS[name]):
        share = f"((t - {at}) / {float(seconds)})"
        path = {"range": f"1 + {size} * sin({share} * 2 * pi())", "gap": f"1 + {size}"}.get(kind, f"1 + {size} * {share}")
        parts.append(f"SELECT t, {i} AS phase, {r(f'{level!r} * ({path})', 6)} AS price FROM (SELECT unnest(range({at}, {at + seconds}))::BIGINT AS t)")
        at, level = at + seconds, level * (1 if kind == "range" else 1 + size)
    return " UNION ALL ".join(parts)


@query(_scenario_sql("pump_dump"))
def scenario_prices(spark, d):
    return B.scenario_prices(spark, "pump_dump", noise=0.0).withColumn("price", R(F.col("price"), 6))


@query(f"SELECT l_suppkey, epoch_ms(l_shipdate) AS ts, l_orderkey, l_extendedprice FROM lineitem WHERE l_suppkey = 3 AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' ORDER BY ts DESC, l_orderkey, l_extendedprice LIMIT 40")
def trade_query(spark, d):
    when = F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts")
    t = table(spark, d, "lineitem").where("l_suppkey = 3 AND l_shipdate BETWEEN TIMESTAMP_NTZ '1996-01-01' AND TIMESTAMP_NTZ '1996-12-31'")
    return t.select("l_suppkey", when, "l_orderkey", "l_extendedprice").orderBy(F.desc("ts"), "l_orderkey", "l_extendedprice").limit(40)


# -- streams ---------------------------------------------------------------------------------


def _scratch(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


_LAST5 = "OVER (PARTITION BY symbol ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query(f"WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, id) AS i FROM {TICKS}), {_ema_sql(5, False, 'price')} SELECT n.symbol, n.id, {r('sma', 3)} AS sma, {r('e.y', 3)} AS ema, {r('sd', 3)} AS sd, low, high FROM (SELECT *, avg(price) {_LAST5} AS sma, stddev_pop(price) {_LAST5} AS sd, min(price) {_LAST5} AS low, max(price) {_LAST5} AS high FROM n) n JOIN e ON n.symbol = e.symbol AND n.i = e.i")
def stream_indicators(spark, d):
    from ..streaming.indicators import run_to_end, stream_indicators as indicators

    rows = _event_stream(spark, d).select(F.col("event_type").alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("price"))
    path = _scratch(spark)
    out = run_to_end(indicators(rows, 5), f"{path}/rows", f"{path}/state")
    return out.select("symbol", "id", R(F.col("sma"), 3).alias("sma"), R(F.col("ema"), 3).alias("ema"), R(F.col("std"), 3).alias("sd"), "low", "high")


@query(f"SELECT symbol, bucket, open, high, low, close, volume FROM {HOURLY}")
def stream_ohlcv(spark, d):
    """The stream's own bars. A last tick far in the future moves the watermark past all others; its bar stays open."""
    from ..streaming.indicators import run_to_end, stream_ohlcv as bars

    rows = _event_stream(spark, d).select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("id"), F.col("value").alias("price"))
    path = _scratch(spark)
    spark.range(1).select(F.lit(None).cast("string").alias("symbol"), F.timestamp_seconds(F.lit(1 << 33)).alias("time"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("price")).write.parquet(f"{path}/end")
    end = spark.readStream.schema(rows.schema).parquet(f"{path}/end")
    return run_to_end(bars(rows.unionByName(end), "1 hour", "0 seconds"), f"{path}/rows", f"{path}/state")


# -- partitions and stored bars --------------------------------------------------------------


@query(f"SELECT id, ts, price FROM {TICKS} WHERE ts >= {AT} AND ts < {AT + 2 * DAY}")
def partitioned_scan(spark, d):
    """Write ticks by UTC day, then read two days back: the day's predicate prunes folders."""
    path = _scratch(spark)
    t = ticks(spark, d).withColumn("day", S.time_label(F.col("ts"), "day"))
    t.repartition("day").write.partitionBy("day").parquet(path)
    days = [f"2024-01-{k}" for k in (15, 16, 17)]
    back = spark.read.schema(t.schema).parquet(path)
    return back.where(F.col("day").isin(*days) & (F.col("ts") >= AT) & (F.col("ts") < AT + 2 * DAY)).select("id", "ts", "price")


@query(f"SELECT symbol, bucket, {r('equity', 2)} AS equity FROM {_EQ} WHERE symbol = 'click' ORDER BY bucket")
def equity_curve_query(spark, d):
    return _equity(spark, d).where("symbol = 'click'").orderBy("bucket").select("symbol", "bucket", R(F.col("equity"), 2).alias("equity"))


def _kline_rows(spark, d):
    from ..schema import KLINE

    have = {"symbol": F.col("symbol"), "interval": F.lit("1h"), "timestamp": (F.col("bucket") / 1000).cast("long"), "open": F.col("open"), "high": F.col("high"), "low": F.col("low"), "close": F.col("close"), "volume": F.col("volume").cast("double")}
    return hourly(spark, d).select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in KLINE])


@query(f"SELECT symbol, bucket, close FROM {HOURLY} WHERE symbol = 'click' AND bucket >= {AT - 5 * DAY} AND bucket <= {AT}")
def kline_store_query(spark, d):
    """Hourly bars through the store: insert, upsert of the same bars (no change), range query."""
    from ..sources.kline_store import KlineStore

    rows = _kline_rows(spark, d)
    store = KlineStore(spark, _scratch(spark), 4)
    store.insert(rows)
    store.upsert(rows.where("symbol = 'click'"))
    got = store.query("click", "1h", (AT - 5 * DAY) // 1000, AT // 1000)
    return got.select("symbol", (F.col("timestamp") * 1000).alias("bucket"), "close")


@query(f"SELECT (bucket // 86400000) * 86400 AS bucket, arg_min(open, bucket) AS open_first, max(high) AS high_max, {r('sum(volume)', 3)} AS volume_sum FROM {HOURLY} WHERE symbol = 'view' GROUP BY ALL")
def store_sample_by(spark, d):
    """Daily buckets of one symbol's stored hourly bars."""
    from ..sources.kline_store import KlineStore

    store = KlineStore(spark, _scratch(spark), 4)
    store.insert(_kline_rows(spark, d))
    out = store.sample_by("view", "60m", {"open": ["first"], "high": ["max"], "volume": ["sum"]}, "1d")
    return out.withColumn("volume_sum", R(F.col("volume_sum"), 3))


@query(f"SELECT sum(n)::BIGINT AS n, min(bucket) // 1000 AS earliest, max(bucket) // 1000 AS newest FROM (SELECT *, 1 AS n FROM {HOURLY})")
def store_header(spark, d):
    """Rows and times of the store's files, taken together."""
    from ..sources.kline_store import KlineStore

    store = KlineStore(spark, _scratch(spark), 4)
    store.insert(_kline_rows(spark, d))
    return store.header().agg(F.sum("n").alias("n"), F.min("earliest").alias("earliest"), F.max("newest").alias("newest"))
