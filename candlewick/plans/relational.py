"""Projections, filters, joins, aggregates, sorting, windows, changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dml
from ..operators import indicators as I
from ..sources.tables import HOUR, hourly, register, table, ticks
from .registry import HOURLY, TICKS, query, r

R = S.round_half_up


def prefixed(df, alias: str):
    """df with its columns named `alias.column`, as SELECT * over a join names them."""
    return df.select(*[F.col(c).alias(f"{alias}.{c}") for c in df.columns])


@query('SELECT c.c_custkey AS "c.c_custkey", c.c_nationkey AS "c.c_nationkey", n.n_nationkey AS "n.n_nationkey", n.n_name AS "n.n_name" FROM (SELECT c_custkey, c_nationkey FROM customer) c JOIN (SELECT n_nationkey, n_name FROM nation) n ON c.c_nationkey = n.n_nationkey')
def join_select_star(spark, d):
    c = prefixed(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c")
    n = prefixed(table(spark, d, "nation").select("n_nationkey", "n_name"), "n")
    return c.join(n, F.col("`c.c_nationkey`") == F.col("`n.n_nationkey`"))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c_name, ''), lambda x: ascii(x)::BIGINT)), lambda h, c: list_reduce(list_prepend(xor(h, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: xor(a >> 1, (a & 1) * 3988292384)))"


@query(f"SELECT c_custkey, xor({_CRC}, 4294967295) AS crc FROM customer")
def crc32_text(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.crc32(F.col("c_name").cast("binary")).alias("crc"))


# -- projection and filter -------------------------------------------------------------------


@query(f"SELECT l_orderkey, l_linenumber, {r('l_extendedprice * (1 - l_discount) + l_tax')} AS net, {r('-l_quantity % 7')} AS rem, l_quantity / 2 AS half FROM lineitem")
def project_expr(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R(F.col("l_extendedprice") * (1 - F.col("l_discount")) + F.col("l_tax"), 4).alias("net"), R(S.remainder(-F.col("l_quantity"), F.lit(7.0)), 4).alias("rem"), (F.col("l_quantity") / 2).alias("half"))


@query("SELECT c_custkey, coalesce(c_name, '') || '/' || coalesce(c_mktsegment, '') AS label FROM customer")
def concat_op(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.concat_text(F.col("c_name"), F.lit("/"), F.col("c_mktsegment")).alias("label"))


@query(f"SELECT event_id, {r('sqrt(abs(value))')} AS a, {r('CASE WHEN value > 0 THEN ln(value) END')} AS b, {r('exp(value / 1000)')} AS c, {r('pow(value, 2)', 2)} AS e, least(value, 10) AS lo, greatest(value, 10) AS hi FROM events")
def math_scalars(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", R(F.sqrt(F.abs(v)), 4).alias("a"), R(S.natural_log(v), 4).alias("b"), R(F.exp(v / 1000), 4).alias("c"), R(F.pow(v, F.lit(2)), 2).alias("e"), F.least(v, F.lit(10.0)).alias("lo"), F.greatest(v, F.lit(10.0)).alias("hi"))


@query(f"SELECT l_orderkey, l_linenumber, {r('-l_extendedprice', 0)} AS whole, {r('l_extendedprice / 3', 2)} AS cents FROM lineitem")
def round_half_up(spark, d):
    x = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R(-x).alias("whole"), R(x / 3, 2).alias("cents"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F'")
def filter_compare(spark, d):
    return table(spark, d, "orders").where((F.col("o_totalprice") >= 100000) & (F.col("o_orderstatus") != "F")).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 40 OR l_discount < 0.02) AND NOT (l_returnflag = 'R' OR l_linestatus = 'O')")
def filter_bool_tree(spark, d):
    c = F.col
    return table(spark, d, "lineitem").where(((c("l_quantity") > 40) | (c("l_discount") < 0.02)) & ~((c("l_returnflag") == "R") | (c("l_linestatus") == "O"))).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE 'b%ld_ng'")
def filter_ilike(spark, d):
    return table(spark, d, "customer").where(S.matches(F.col("c_mktsegment"), "b%ld_ng")).select("c_custkey", "c_mktsegment")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase', 'view')")
def filter_in_list(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "purchase", "view")).select("event_id", "event_type")


@query("SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O'))")
def filter_tuple_in(spark, d):
    register(spark, d, "lineitem")
    return spark.sql("SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O'))")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def filter_in_subquery(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def filter_not_in_subquery(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT event_id, value FROM events WHERE value > 50")
def filter_scan(spark, d):
    return table(spark, d, "events").where("value > 50").select("event_id", "value")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 50000 AND l_quantity > 30")
def filter_price_volume(spark, d):
    return table(spark, d, "lineitem").where("l_extendedprice > 50000 AND l_quantity > 30").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS i FROM events) WHERE i > 100 AND i <= 150")
def slice_rows(spark, d):
    return table(spark, d, "events").orderBy("ts", "event_id").offset(100).limit(50).select("event_id", "value")


# -- joins -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def join_left(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey")
def join_multi_key(spark, d):
    on = (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_custkey") == F.col("s_suppkey"))
    return table(spark, d, "customer").join(table(spark, d, "supplier"), on).select("c_custkey", "s_suppkey")


@query(f"SELECT r_name, count(*) AS n, {r('sum(o_totalprice)', 1)} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name HAVING count(*) > 10")
def join_chain_agg(spark, d):
    o, c, n, g = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.count("*").alias("n"), R(F.sum("o_totalprice"), 1).alias("total")).where("n > 10")


# -- aggregation -----------------------------------------------------------------------------


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, {r('sum(l_quantity)', 1)} AS q, {r('avg(l_extendedprice)', 2)} AS p, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY ALL")
def group_by_basic(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), R(F.sum("l_quantity"), 1).alias("q"), R(F.avg("l_extendedprice"), 2).alias("p"), F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi"))


@query(f"SELECT count(*) AS n, count(value) AS nv, {r('sum(value)', 2)} AS s, {r('avg(value)')} AS a, min(value) AS lo, max(value) AS hi FROM events")
def agg_global(spark, d):
    v = S.finite(F.col("value"))
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.count(v).alias("nv"), R(F.sum(v), 2).alias("s"), R(F.avg(v), 4).alias("a"), F.min(v).alias("lo"), F.max(v).alias("hi"))


@query(f"SELECT user_id, event_type, count(*) AS n, {r('coalesce(var_samp(value), 0)', 3)} AS v, {r('coalesce(stddev_samp(value), 0)')} AS sd FROM events GROUP BY ALL")
def agg_stats(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), R(F.coalesce(F.var_samp("value"), F.lit(0.0)), 3).alias("v"), R(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("sd"))


@query(f"SELECT symbol, arg_min(price, ts) AS first_price, arg_max(price, ts) AS last_price, arg_min(user_id, ts) AS first_user FROM {TICKS} GROUP BY symbol")
def agg_first_last(spark, d):
    o = F.struct("ts", "id")
    return ticks(spark, d).groupBy("symbol").agg(F.min_by("price", o).alias("first_price"), F.max_by("price", o).alias("last_price"), F.min_by("user_id", o).alias("first_user"))


@query(f"SELECT user_id, count(*) AS c, {r('avg(value)')} AS av FROM events GROUP BY user_id HAVING count(*) > 5 AND avg(value) > 20")
def having_alias(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("c"), F.avg("value").alias("av"))
    return g.where("c > 5 AND av > 20").withColumn("av", R(F.col("av"), 4))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def distinct_values(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT user_id, max(epoch_us(ts) // 1000) AS newest, max(value) AS most FROM events GROUP BY user_id")
def max_per_key(spark, d):
    return ticks(spark, d).groupBy("user_id").agg(F.max("ts").alias("newest"), F.max("price").alias("most"))


@query(f"SELECT symbol, count(*) AS n, min(bucket) AS earliest, max(bucket) AS newest, {r('avg(close)')} AS avg_close, min(low) AS min_low, max(high) AS max_high FROM {HOURLY} GROUP BY symbol")
def symbol_stats(spark, d):
    return hourly(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.min("bucket").alias("earliest"), F.max("bucket").alias("newest"), R(F.avg("close"), 4).alias("avg_close"), F.min("low").alias("min_low"), F.max("high").alias("max_high"))


@query(f"SELECT count(*) AS n, count(DISTINCT symbol) AS symbols, count(DISTINCT bucket) AS buckets FROM {HOURLY}")
def store_stats(spark, d):
    return hourly(spark, d).agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("bucket").alias("buckets"))


_PNL = "l_extendedprice * (l_discount - l_tax)"


@query(f"SELECT l_suppkey, count(*) AS trades, CAST(sum(CASE WHEN p > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN p < 0 THEN 1 ELSE 0 END) AS BIGINT) AS losses, {r('sum(p)', 2)} AS total, {r('avg(p)', 3)} AS mean, {r('100.0 * sum(CASE WHEN p > 0 THEN 1 ELSE 0 END) / count(*)')} AS win_rate FROM (SELECT *, {_PNL} AS p FROM lineitem) GROUP BY l_suppkey")
def trade_stats(spark, d):
    t = table(spark, d, "lineitem").withColumn("p", F.expr(_PNL))
    wins = F.sum(F.when(F.col("p") > 0, 1).otherwise(0))
    return t.groupBy("l_suppkey").agg(F.count("*").alias("trades"), wins.alias("wins"), F.sum(F.when(F.col("p") < 0, 1).otherwise(0)).alias("losses"), R(F.sum("p"), 2).alias("total"), R(F.avg("p"), 3).alias("mean"), R(100.0 * wins / F.count("*"), 4).alias("win_rate"))


# -- sorting, limits, common table expressions -----------------------------------------------


@query("SELECT o_orderkey, o_totalprice, o_totalprice / 2 AS half FROM orders ORDER BY o_totalprice * -1, 1 LIMIT 50")
def order_expr_ordinal(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") / 2).alias("half")).orderBy(F.col("o_totalprice") * -1, "o_orderkey").limit(50)


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 20 OFFSET 30")
def limit_offset(spark, d):
    return table(spark, d, "events").select("event_id", "value").orderBy("event_id").offset(30).limit(20)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


_CTE = "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM big GROUP BY o_custkey) SELECT c_name, n, most FROM per JOIN customer ON o_custkey = c_custkey WHERE n > 2"


@query(_CTE)
def cte_chain(spark, d):
    register(spark, d, "orders", "customer")
    return spark.sql(_CTE)


_DERIVED = "SELECT s.k, s.n FROM (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY l_partkey) s WHERE s.n > 25"


@query(_DERIVED)
def derived_table(spark, d):
    register(spark, d, "lineitem")
    return spark.sql(_DERIVED)


@query(f"SELECT symbol, ts, price FROM {TICKS} WHERE symbol = 'click' UNION ALL SELECT symbol, ts, price FROM {TICKS} WHERE price > 80")
def union_all_merge(spark, d):
    t = ticks(spark, d).select("symbol", "ts", "price")
    return t.where("symbol = 'click'").unionByName(t.where("price > 80"))


@query("SELECT event_id, event_type FROM events ORDER BY event_type, event_id")
def sort_gather(spark, d):
    return table(spark, d, "events").select("event_id", "event_type").orderBy("event_type", "event_id")


# -- windows ---------------------------------------------------------------------------------



def _w():
    return Window.partitionBy("symbol").orderBy("ts", "id")


def _run():
    return _w().rowsBetween(Window.unboundedPreceding, 0)


_OVER = "OVER (PARTITION BY symbol ORDER BY ts, id ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_FIVE, _ALL = _OVER.format(4), _OVER.format("UNBOUNDED")


def _windowed(spark, d, **columns):
    return ticks(spark, d).select("id", "symbol", *[v.alias(k) for k, v in columns.items()])


@query(f"SELECT id, symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts, id) AS BIGINT) AS rn FROM {TICKS}")
def row_number(spark, d):
    return _windowed(spark, d, rn=F.row_number().over(_w()).cast("long"))


@query(f"SELECT id, symbol, count(*) {_FIVE} AS n FROM {TICKS}")
def win_count(spark, d):
    return _windowed(spark, d, n=F.count("*").over(_w().rowsBetween(-4, 0)))


@query(f"SELECT id, symbol, {r(f'sum(price) {_FIVE}', 3)} AS s FROM {TICKS}")
def win_sum(spark, d):
    return _windowed(spark, d, s=R(F.sum("price").over(_w().rowsBetween(-4, 0)), 3))


@query(f"SELECT id, symbol, {r(f'avg(price) {_FIVE}', 3)} AS a FROM {TICKS}")
def win_avg(spark, d):
    return _windowed(spark, d, a=R(F.avg("price").over(_w().rowsBetween(-4, 0)), 3))


@query(f"SELECT id, symbol, min(price) {_FIVE} AS lo, max(price) {_FIVE} AS hi FROM {TICKS}")
def win_minmax(spark, d):
    w = _w().rowsBetween(-4, 0)
    return _windowed(spark, d, lo=F.min("price").over(w), hi=F.max("price").over(w))


@query(f"SELECT id, symbol, {r(f'coalesce(var_samp(price) {_FIVE}, 0)', 6)} AS v, {r(f'coalesce(stddev_samp(price) {_FIVE}, 0)', 6)} AS sd FROM {TICKS}")
def win_stddev(spark, d):
    w = _w().rowsBetween(-4, 0)
    return _windowed(spark, d, v=R(F.coalesce(F.var_samp("price").over(w), F.lit(0.0)), 6), sd=R(F.coalesce(F.stddev_samp("price").over(w), F.lit(0.0)), 6))


@query(f"SELECT id, symbol, {r(f'avg(price) {_FIVE}', 3)} AS a, min(price) {_FIVE} AS lo, count(*) {_FIVE} AS n FROM {TICKS}")
def win_sliced(spark, d):
    """Count windows without a task that orders a whole symbol: six hours at a time."""
    out = I.rolling_in_slices(ticks(spark, d), ["symbol"], "ts", ["id"], 5, 6 * HOUR, lambda w: {"a": F.avg("price").over(w), "lo": F.min("price").over(w), "n": F.count("*").over(w)})
    return out.select("id", "symbol", R(F.col("a"), 3).alias("a"), "lo", "n")


@query(f"SELECT id, symbol, {r(f'sum(price) {_ALL}', 2)} AS s, count(*) {_ALL} AS n FROM {TICKS}")
def win_running_default(spark, d):
    return _windowed(spark, d, s=R(F.sum("price").over(_run()), 2), n=F.count("*").over(_run()))


@query(f"SELECT id, symbol, {r(f'coalesce(stddev_samp(price) {_FIVE}, 0) / (abs(price) + 1) * 100', 6)} AS x FROM {TICKS}")
def win_inline_expr(spark, d):
    sd = F.coalesce(F.stddev_samp("price").over(_w().rowsBetween(-4, 0)), F.lit(0.0))
    return _windowed(spark, d, x=R(sd / (F.abs("price") + 1) * 100, 6))


@query(f"SELECT user_id, id, ts, price FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rn FROM {TICKS}) WHERE rn = 1")
def top1_per_group(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))
    return ticks(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "id", "ts", "price")


@query(f"SELECT id, ts, {r('avg(price) OVER (ORDER BY ts, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} AS a FROM {TICKS} ORDER BY ts DESC, id DESC LIMIT 1")
def tail_window(spark, d):
    # the window needs the last 20 rows only, so they are taken first (top-k, no full sort)
    last = ticks(spark, d).orderBy(F.desc("ts"), F.desc("id")).limit(20)
    return last.agg(F.max_by("id", F.struct("ts", "id")).alias("id"), F.max("ts").alias("ts"), R(F.avg("price"), 4).alias("a"))


# -- changes ---------------------------------------------------------------------------------

_OLD = f"(SELECT symbol, bucket, close, volume FROM {HOURLY} WHERE bucket % 7200000 = 0)"
_NEW = f"(SELECT symbol, bucket, close + 1 AS close, volume FROM {HOURLY} WHERE bucket % 10800000 = 0)"


def _old(spark, d):
    return hourly(spark, d).where(F.col("bucket") % (2 * HOUR) == 0).select("symbol", "bucket", "close", "volume")


def _new(spark, d):
    return hourly(spark, d).where(F.col("bucket") % (3 * HOUR) == 0).select("symbol", "bucket", (F.col("close") + 1).alias("close"), "volume")


@query(f"SELECT symbol, bucket, close, volume FROM {_OLD} UNION ALL SELECT symbol, bucket, close, NULL FROM {_NEW}")
def insert_union(spark, d):
    return dml.insert(_old(spark, d), _new(spark, d).drop("volume"))


@query(f"SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(n.bucket, o.bucket) AS bucket, coalesce(n.close, o.close) AS close, coalesce(n.volume, o.volume) AS volume FROM {_OLD} o FULL JOIN {_NEW} n ON o.symbol = n.symbol AND o.bucket = n.bucket")
def upsert_merge(spark, d):
    return dml.upsert(_old(spark, d), _new(spark, d), ["symbol", "bucket"])


@query(f"WITH o AS {_OLD}, m AS (SELECT symbol, max(bucket) - 36000000 AS newest FROM o GROUP BY symbol) SELECT o.symbol, bucket, close, volume FROM o JOIN m ON o.symbol = m.symbol WHERE bucket <= newest UNION ALL SELECT n.symbol, bucket, close, volume FROM {_NEW} n JOIN (SELECT o.symbol, max(bucket) AS top FROM o JOIN m ON o.symbol = m.symbol WHERE bucket <= newest GROUP BY o.symbol) t ON n.symbol = t.symbol WHERE bucket > top")
def upsert_newer_only(spark, d):
    old = _old(spark, d)
    newest = old.groupBy("symbol").agg((F.max("bucket") - 10 * HOUR).alias("newest"))
    old = old.join(newest, "symbol").where("bucket <= newest").drop("newest")
    return dml.newer_only(old, _new(spark, d), ["symbol"], "bucket")


@query("SELECT event_id, value FROM events WHERE NOT (value > 50 AND event_type = 'click')")
def delete_where(spark, d):
    return dml.delete(table(spark, d, "events"), (F.col("value") > 50) & (F.col("event_type") == "click")).select("event_id", "value")


@query("SELECT event_id, CASE WHEN value >= 30 THEN value * 10 ELSE value END AS value, CASE WHEN value >= 30 THEN 'big' ELSE event_type END AS event_type FROM events")
def update_where(spark, d):
    return dml.update(table(spark, d, "events"), F.col("value") >= 30, {"value": F.col("value") * 10, "event_type": F.lit("big")}).select("event_id", "value", "event_type")


@query("SELECT event_id, value FROM events WHERE event_id % 5 <> 0")
def tombstone_anti(spark, d):
    e = table(spark, d, "events")
    return dml.without(e, e.where("event_id % 5 = 0").select("event_id"), ["event_id"]).select("event_id", "value")


@query("SELECT count(*) AS \"before\", CAST(sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) AS BIGINT) AS \"after\", CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS deleted FROM events")
def delete_counts(spark, d):
    e = table(spark, d, "events")
    return dml.counts(e, dml.delete(e, F.col("value") > 50))


@query(f"SELECT n.symbol, n.bucket, coalesce(n.close, o.close) AS close, CASE WHEN o.symbol IS NULL THEN n.volume ELSE o.volume END AS volume FROM {_NEW} n LEFT JOIN {_OLD} o ON o.symbol = n.symbol AND o.bucket = n.bucket UNION ALL SELECT o.symbol, o.bucket, o.close, o.volume FROM {_OLD} o ANTI JOIN {_NEW} n ON o.symbol = n.symbol AND o.bucket = n.bucket")
def upsert_set_columns(spark, d):
    """On conflict only close is set; volume stays."""
    return dml.upsert(_old(spark, d), _new(spark, d), ["symbol", "bucket"], changes=["close"])


@query(f"SELECT event_type AS symbol, arg_max(value, event_id) AS price, max(event_id) AS id FROM events GROUP BY event_type")
def upsert_last_wins(spark, d):
    """All events as new rows of one table keyed by type: the row with the largest id stays."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.col("event_id").alias("id"))
    return dml.upsert(rows.where("false"), rows, ["symbol"], order=F.col("id"))


# -- access paths: only their results matter; files sorted by the keys let Parquet skip row groups ------------


@query(f"SELECT id, price FROM {TICKS} WHERE user_id = 7")
def index_exact(spark, d):
    return ticks(spark, d).where("user_id = 7").select("id", "price")


@query("SELECT event_id, value FROM events WHERE event_id >= 100 AND event_id <= 250")
def index_range(spark, d):
    return table(spark, d, "events").where(F.col("event_id").between(100, 250)).select("event_id", "value")


@query(f"SELECT id, ts FROM {TICKS} WHERE symbol = 'view' AND user_id = 3 AND ts >= 1704500000000 AND ts < 1706000000000")
def index_prefix_range(spark, d):
    t = ticks(spark, d)
    return t.where((t.symbol == "view") & (t.user_id == 3) & (t.ts >= 1704500000000) & (t.ts < 1706000000000)).select("id", "ts")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type")
def index_any_of(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("view", "click")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, CAST(l_orderkey AS DOUBLE) AS wide, CAST(trunc(l_extendedprice) AS BIGINT) AS narrow FROM lineitem")
def cast_numbers(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_orderkey").cast("double").alias("wide"), F.col("l_extendedprice").cast("bigint").alias("narrow"))


@query("SELECT * FROM (VALUES (1::BIGINT, 10.5::DOUBLE), (2, 20.0), (3, NULL)) t(k, v)")
def create_and_insert(spark, d):
    from ..schema import schema_of

    made = spark.createDataFrame([], schema_of([("k", "BIGINT"), ("v", "DECIMAL")]))
    made = dml.insert(made, spark.createDataFrame([(1, 10.5), (2, 20.0)], "k long, v double"))
    return dml.insert(made, spark.createDataFrame([(3,)], "k long"))


@query("SELECT l_returnflag, count(*) AS n, arg_min(l_comment_key, l_comment_key) AS any_key FROM (SELECT *, l_orderkey * 10 + l_linenumber AS l_comment_key FROM lineitem) GROUP BY l_returnflag")
def ungrouped_column(spark, d):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min_by(key, key).alias("any_key"))
