"""Small tables with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from candlewick.functions import scalars as S
from candlewick.operators import backtest as B
from candlewick.operators import dml
from candlewick.operators import indicators as I
from candlewick.operators import timeseries as T
from candlewick.schema import KLINE, interval_seconds, schema_of
from candlewick.sources.kline_store import KlineStore, migrate

CLOSE = [100, 102, 101, 105, 107, 106, 108, 110, 109, 112]
HIGH = [101, 103, 102, 106, 108, 107, 109, 111, 110, 113]
LOW = [99, 101, 100, 104, 106, 105, 107, 109, 108, 111]
VOLUME = [1000, 1200, 900, 1500, 1300, 1100, 1400, 1600, 1200, 1700]


@pytest.fixture(scope="module")
def ten(spark):
    rows = [("A", i, float(c), float(h), float(l), float(v)) for i, (c, h, l, v) in enumerate(zip(CLOSE, HIGH, LOW, VOLUME, strict=True))]
    return spark.createDataFrame(rows, "symbol string, t long, close double, high double, low double, volume double")


def last(df, column):
    return df.orderBy(F.desc("t")).first()[column]




def w():
    return I.over(["symbol"], ["t"])


@pytest.mark.parametrize(("indicator", "expected"), [(I.sma, 109), (I.wma, 109.866667), (I.momentum, 5), (I.roc, 4.672897)])
def test_window_indicators(ten, indicator, expected):
    assert last(ten.withColumn("x", indicator("close", 5, w())), "x") == pytest.approx(expected, abs=1e-5)


def test_folded_indicators(ten):
    k, o = ["symbol"], ["t"]
    assert last(I.ema(ten, k, o, "close", 5, True), "ema") == pytest.approx(109.061728, abs=1e-5)
    assert last(I.ema(ten, k, o, "close", 5, False), "ema") == pytest.approx(109.165778, abs=1e-5)
    assert last(I.rsi(ten, k, o, "close", 5), "rsi") == pytest.approx(84.12549, abs=1e-4)
    assert last(I.atr(ten, k, o, "high", "low", "close", 5), "atr") == pytest.approx(3.04, abs=1e-2)
    assert last(I.ema_in_chunks(ten, k, o, "close", 5, 3), "ema") == pytest.approx(109.165778, abs=1e-5)


def test_obv_and_bollinger(ten):
    assert last(ten.withColumn("v", I.obv("close", "volume", w())).withColumn("x", F.sum("v").over(w().rowsBetween(-100, 0))), "x") == 6500
    up, mid, low = (last(ten.select("t", *I.bollinger("close", 5, 2, w())), c) for c in ("upper", "middle", "lower"))
    assert (up, mid, low) == pytest.approx((113, 109, 105))


def test_rising_series_stops_short_of_100(spark):
    up = spark.createDataFrame([("A", i, float(i)) for i in range(30)], "symbol string, t long, close double")
    assert last(I.rsi(up, ["symbol"], ["t"], "close"), "rsi") == pytest.approx(99.0099, abs=1e-4)


def test_partial_sma(spark):
    df = spark.createDataFrame([("A", i, float(i)) for i in range(1, 6)], "symbol string, t long, close double")
    assert [r.x for r in df.withColumn("x", I.sma_partial("close", 3, w())).orderBy("t").collect()] == [1, 1.5, 2, 3, 4]


def test_delta_round_trip(ten):
    coded = ten.withColumn("d", I.delta_encode("volume", w())).withColumn("back", I.prefix_sum("d", w()))
    assert coded.where("back <> volume").count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([(-2.5, "BTC", None)], "x double, s string, n string")
    row = df.select(S.round_half_up(F.col("x")).alias("r"), S.polynomial_hash(F.col("s")).alias("h"), S.concat_text(F.col("s"), F.col("n")).alias("c"), S.divide(F.col("x"), F.lit(0.0)).alias("z"), S.finite(F.lit(float("nan"))).alias("f")).first()
    assert tuple(row) == (-2, 66 * 961 + 84 * 31 + 67, "BTC", None, None)
    assert spark.range(1).select(interval_seconds("4h").alias("s")).first().s == 14400
    assert schema_of([("a", "BIGINT"), ("b", "decimal")]).simpleString() == "struct<a:bigint,b:double>"
    with pytest.raises(ValueError):
        schema_of([("a", "BLOB")])


def test_buckets(spark):
    df = spark.createDataFrame([(0, 1), (500, 2), (1000, 3), (1500, 4), (2000, 5)], "ts long, v int")
    got = T.sample_by(df, "ts", 1000, {"v": ["sum"]}).orderBy("bucket").collect()
    assert [(r.bucket, r.v_sum) for r in got] == [(0, 3), (1000, 7), (2000, 5)]


def test_count_bars_keep_the_first_of_equal_times_as_sql_does(spark):
    rows = [("a", 1, 1, 5.0), ("a", 1, 2, 6.0), ("a", 2, 3, 7.0), ("a", 2, 4, 8.0), ("a", 2, 5, 9.0), ("a", 3, 6, None), ("a", 3, 7, None)]
    ticks = spark.createDataFrame(rows, "symbol string, ts long, id long, price double").withColumn("one", F.lit(1))
    got = T.count_ohlcv(ticks, "ts", "price", "one", 4, ["symbol"], ["id"]).orderBy("bar").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 5.0, 8.0, 5.0, 7.0, 4), (1, 9.0, 9.0, 9.0, 9.0, 3)]


def test_asof_ties_and_order(spark):
    left = spark.createDataFrame([(1, 10), (2, 20), (3, 5)], "id long, ts long").withColumn("k", F.lit("a"))
    right = spark.createDataFrame([("a", 10, 1.0, 1), ("a", 10, 2.0, 2), ("a", 15, 3.0, 3)], "k string, ts long, q double, i long")
    got = {r.id: r.q for r in T.asof_pairwise(left, right, ["k"], "ts", ["q"], ["i"]).collect()}
    assert got == {1: 2.0, 2: 3.0, 3: None}


def test_dml(spark):
    t = spark.createDataFrame([(i, i) for i in range(1, 6)], "id long, v long")
    gone = dml.delete(t, F.col("v") % 2 == 0)
    assert tuple(dml.counts(t, gone).first()) == (5, 3, 2)
    assert [r.v for r in dml.update(t, F.col("v") >= 3, {"v": F.col("v") * 10}).orderBy("id").collect()] == [1, 2, 30, 40, 50]
    new = spark.createDataFrame([(1, 7, 0), (1, 8, 1), (9, 9, 0)], "id long, v long, seq int")
    merged = dml.upsert(t, new, ["id"], F.col("seq"))
    assert {r.id: r.v for r in merged.collect()} == {1: 8, 2: 2, 3: 3, 4: 4, 5: 5, 9: 9}
    assert dml.upsert(merged, new, ["id"], F.col("seq")).exceptAll(merged).count() == 0


def bar(symbol, ts, close, interval="1m"):
    return (symbol, "x", symbol, "USD", interval, ts, close, close + 1, close - 1, close, 10.0, None, None, None, None)


def test_store(spark, tmp_path):
    s = KlineStore(spark, str(tmp_path / "bars"), 4)
    assert s.read().count() == 0
    s.insert(spark.createDataFrame([bar("A", 60, 1.0), bar("A", 120, 2.0), bar("B", 60, 3.0, "1h")], KLINE))
    s.upsert(spark.createDataFrame([bar("A", 120, 5.0), bar("A", 180, 6.0)], KLINE))
    assert [(r.timestamp, r.close) for r in s.query("A", "1m").collect()] == [(60, 1.0), (120, 5.0), (180, 6.0)]
    s.upsert_newer(spark.createDataFrame([bar("A", 120, 9.0), bar("A", 240, 7.0)], KLINE))
    assert [r.close for r in s.query("A", "1m", newest_first=True, limit=1).collect()] == [7.0]
    assert {(r.symbol, r.close) for r in s.latest().collect()} == {("A", 7.0), ("B", 3.0)}
    s.delete((F.col("symbol") == "B"))
    s.compact()
    assert tuple(s.stats().first()) == (4, 1, 1)
    other = KlineStore(spark, str(tmp_path / "copy"), 2)
    migrate(s, other)
    assert other.read().count() == 4
    assert "PartitionFilters: [isnotnull(bucket" in s.query("A")._jdf.queryExecution().executedPlan().toString()


def test_ledger_balances():
    a = B.Account(1000, fee=0.0)
    a.price["X"] = 10
    assert a.order(1, "X", 50) and not a.order(1, "X", 100)
    assert a.equity() == 1000
    a.price["X"] = 12
    assert a.equity() == 1100
    assert a.order(2, "X", -80) and a.quantity["X"] == -30 and a.entry["X"] == 12
    assert a.fills[-1]["pnl"] == 100
    a.price["X"] = 11
    assert a.order(3, "X", 30) and a.equity() == a.cash == 1130


def test_backtest_runs(spark):
    prices = [10 + (i % 20) * (1 if (i // 20) % 2 == 0 else -1) + 20 * ((i // 20) % 2) for i in range(120)]
    bars = spark.createDataFrame([("r", "X", i, float(p)) for i, p in enumerate(prices)], "run string, symbol string, ts long, close double")
    eq = B.simulate(bars, ["run"], B.MovingAverageCross)
    assert eq.count() == 120 and eq.where("equity <= 0").count() == 0
    m = B.metrics(eq, ["run"]).join(B.trade_metrics(eq, ["run"]), "run").first()
    assert m.fills > 0 and 0 <= m.max_drawdown < 1 and 0 <= m.win_rate <= 1


def test_stream_state_survives_batches(spark, tmp_path):
    from candlewick.streaming.indicators import run_to_end, stream_indicators

    src = tmp_path / "in"
    schema = "symbol string, ts long, id long, price double"
    for k in range(3):
        spark.createDataFrame([("A", 10 * k + i, 10 * k + i, float(10 * (3 * k + i + 1))) for i in range(3)], schema).coalesce(1).write.mode("append").parquet(str(src))
        rows = spark.readStream.schema(schema).parquet(str(src))
        out = run_to_end(stream_indicators(rows, 3), str(tmp_path / "out"), str(tmp_path / "state"))
    got = [r.sma for r in out.orderBy("ts").collect()]
    assert got == [10, 15, 20, 30, 40, 50, 60, 70, 80]


# -- merges ----------------------------------------------------------------------------------


def test_upsert_needs_an_order_for_several_new_rows_of_a_key(spark):
    old = spark.createDataFrame([("a", 1, 10)], "k string, v int, w int")
    new = spark.createDataFrame([("a", k, -k) for k in range(2, 9)] + [("b", 5, 6)], "k string, v int, w int")
    for parts in (1, 5):
        got = dml.upsert(old, new.repartition(parts), ["k"], order=F.col("v"))
        assert sorted(map(tuple, got.collect())) == [("a", 8, -8), ("b", 5, 6)]
    with pytest.raises(Exception, match="need an order"):
        dml.upsert(old, new, ["k"]).collect()
    assert dml.upsert(old, new.where("v = 3 or k = 'b'"), ["k"], changes=["v"]).where("k = 'a'").first() == ("a", 3, 10)
    assert dml.upsert(old, new.where("k = 'b'"), ["k"], changes=["v"]).count() == 2


# -- accounts --------------------------------------------------------------------------------


def test_waiting_limit_orders():
    a = B.Account(1000.0, fee=0.0)
    a.price["X"] = 100.0
    low, high = a.place("X", 2.0, 90.0), a.place("X", -1.0, 120.0)
    assert a.match(1) == [] and a.quantity == {}
    a.price["X"] = 89.0
    assert a.match(2) == [low] and a.quantity["X"] == 2.0 and a.cash == pytest.approx(1000 - 2 * 89)
    a.price["X"] = 121.0
    assert a.match(3) == [high] and a.fills[-1]["pnl"] == pytest.approx(32.0)
    dear, gone = a.place("X", 100.0, 130.0), a.place("X", 1.0, 130.0)
    assert a.cancel(gone) and not a.cancel(gone)
    assert a.match(4) == [] and list(a.pending) == [dear]  # cash does not cover it


def test_sweep_reports_a_failing_set(spark):
    class Broken:
        def __init__(self, fast: int = 1) -> None:
            self.fast = fast

        def __call__(self, account, bar) -> None:
            if self.fast == 2:
                raise RuntimeError("no such average")

    bars = spark.createDataFrame([("r", t, "X", 100.0 + t) for t in range(5)], "run string, ts long, symbol string, close double")
    got = {r.fast: r for r in B.sweep(bars, ["run"], Broken, [{"fast": 1}, {"fast": 2}]).collect()}
    assert got[1].error is None and "no such average" in got[2].error and got[1].n_bars == 5
    assert all(r.seconds >= 0 for r in got.values())


def test_first_touch_against_all_pairs_without_making_them(spark):
    import random

    rnd = random.Random(4)
    odd = [float("nan"), 0.0, -0.0, 5.0]
    quotes = [(s, rnd.randrange(60), rnd.choice([*odd, rnd.uniform(-9, 9)])) for s in "ab" for _ in range(150)]
    wishes = [(i, rnd.choice("abc"), rnd.choice((1, -1)), at := rnd.randrange(60), rnd.choice([*odd, None, rnd.uniform(-15, 15)]), at + rnd.randrange(-2, 40)) for i in range(400)]
    ticks = spark.createDataFrame([*quotes, ("a", 7, None)], "symbol string, ts long, price double")
    orders = spark.createDataFrame(wishes, "id long, symbol string, side int, placed long, limit double, until long").where("until >= placed")
    pairs = orders.join(ticks, "symbol").where("ts > placed and ts <= until and case when side = 1 then price <= limit else price >= limit end")
    want = {r.id: r.filled for r in pairs.groupBy("id").agg(F.min("ts").alias("filled")).collect()}
    for width in (5, 7, 100):
        assert {r.id: r.filled for r in B.first_touch(orders, ticks, "symbol", "ts", "price", width).collect()} == want
    hot = ticks.sparkSession.range(200_000).selectExpr("'a' symbol", "id ts", "double(id % 1000) price")  # 2e10 pairs in one cell
    asked = hot.selectExpr("ts id", "symbol", "1 side", "ts placed", "0.0 limit", "ts + 2000 until")
    got = B.first_touch(asked, hot, "symbol", "ts", "price", 1_000_000)
    assert got.agg(F.count("*"), F.sum(F.col("filled") - F.col("id")), F.max(F.col("filled") % 1000)).first() == (199_000, 199 * 500_500, 0)


def test_random_walk_does_not_depend_on_its_chunks(spark):
    one, many = ([round(r.price, 9) for r in B.random_walk(spark, 500, chunk=c).orderBy("t").collect()] for c in (1 << 16, 7))
    assert one == many and len(set(one)) == 500


# -- stored bars -----------------------------------------------------------------------------


def test_checksums_tiers_and_headers(spark, tmp_path):
    row = lambda s, t, c: (s, None, None, None, "1h", t, c, c, c, c, 1.0, None, None, None, None)
    bars = spark.createDataFrame([row(s, t * 3600, float(t)) for s in "ab" for t in range(10)], KLINE)
    hot, cold = KlineStore(spark, f"file://{tmp_path}/hot", 3), KlineStore(spark, f"file://{tmp_path}/cold", 3)
    hot.insert(bars)
    known = spark.createDataFrame(hot.checksums().collect(), hot.checksums().schema)
    hot.compact()
    assert hot.verify(known).count() == 0
    hot.upsert(spark.createDataFrame([row("a", 0, 99.0), row("a", 0, 98.0)], KLINE), order=F.col("close"))
    assert hot.verify(known).count() == 1 and hot.query("a", "1h", 0, 0).first().close == 99.0
    h = hot.header().agg(F.sum("n").alias("n"), F.min("earliest").alias("a"), F.max("newest").alias("b"), F.min("bytes").alias("bytes")).first()
    assert (h.n, h.a, h.b) == (20, 0, 9 * 3600) and h.bytes > 0
    hot.tier(cold, 5 * 3600)
    assert (hot.read().count(), cold.read().count()) == (10, 10) and hot.header().agg(F.min("earliest")).first()[0] == 5 * 3600
    got = cold.sample_by("a", "60m", {"close": ["max"], "open": ["count"]}, "2h").orderBy("bucket").collect()
    assert [(r.bucket, r.close_max, r.open_count) for r in got] == [(0, 99.0, 2), (7200, 3.0, 2), (14400, 4.0, 1)]
    assert cold.sample_by("a", "1h", {"close": ["max"]}).count() == 5


def test_intervals_by_name():
    from candlewick.schema import canonical, seconds_of

    assert [canonical(x) for x in ("1h", "60m", "7m", "1440m")] == ["1h", "1h", "7m", "1d"]
    assert [seconds_of(x) for x in ("30s", "5m", "1h", "2d", "1M")] == [30, 300, 3600, 172800, 2592000]
    for bad in ("", "h", "0m", "x1"):
        with pytest.raises(ValueError):
            seconds_of(bad)


def test_ledger_store(spark, tmp_path):
    from candlewick.schema import EQUITY, TRADE
    from candlewick.sources.ledger_store import LedgerStore

    day = 86_400_000
    store = LedgerStore(spark, f"file://{tmp_path}/ledger")
    store.append("trades", spark.createDataFrame([(k, k, k % 2, 1, 1.0, 10.0, 0.1, float(k - 2), k * day // 2) for k in range(6)], TRADE))
    store.append("equity", spark.createDataFrame([(k * day, 100.0 + k, 0.0, 0.0, 0.0) for k in range(4)], EQUITY))
    assert [r.trade_id for r in store.query("trades", day, 3 * day).collect()] == [2, 3, 4, 5]
    assert [r.trade_id for r in store.query("trades", 0, 3 * day, F.col("pnl") > 0, limit=2).collect()] == [5, 4]
    assert [r.total_equity for r in store.query("equity", day, 3 * day).collect()] == [101.0, 102.0]
    assert {r.symbol_id: (r.n, r.pnl, r.win_rate) for r in store.summary(0, 3 * day).collect()} == {0: (3, 0.0, pytest.approx(1 / 3)), 1: (3, 3.0, pytest.approx(2 / 3))}
    assert "PartitionFilters: [isnotnull(day" in store.query("trades", day, 3 * day)._jdf.queryExecution().executedPlan().toString()


def test_stream_commands(spark, tmp_path):
    from candlewick.streaming.indicators import run_to_end, stream_indicators

    schema = "symbol string, ts long, id long, price double, command string"
    steps = [("A", 0, 0, 10.0, "fill"), ("A", 1, 1, 20.0, None), ("A", 2, 2, None, "reset"), ("A", 3, 3, 40.0, None), ("A", 4, 4, None, "remove"), ("A", 5, 5, 50.0, None), ("A", 6, 6, None, "add"), ("A", 7, 7, 70.0, None), ("A", 8, 8, 80.0, None), ("B", 0, 9, 1.0, None), ("B", 1, 10, 2.0, None)]
    for k in range(0, len(steps), 4):
        spark.createDataFrame(steps[k : k + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = run_to_end(stream_indicators(rows, 3, periods={"B": 1}), str(tmp_path / "out"), str(tmp_path / "state"))
    assert [(r.id, r.sma) for r in out.orderBy("id").collect()] == [(1, 15.0), (3, 40.0), (7, 70.0), (8, 75.0), (9, 1.0), (10, 2.0)]


def test_stream_gives_a_symbol_in_pieces_with_the_same_values(spark, tmp_path, monkeypatch):
    from candlewick.streaming import indicators

    class Held:  # stands for the state of one symbol
        exists, got = False, None

        def update(self, state):
            self.got = state

    class Rows:
        columns, sparkSession = ["symbol", "ts", "id", "price", "command"], spark
        groupBy = lambda self, key: self
        applyInPandasWithState = lambda self, update, *a: update

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 5000
    frame = pd.DataFrame({"symbol": "A", "ts": rng.integers(0, 900, n), "id": rng.permutation(n), "price": rng.normal(size=n), "command": rng.choice([None, "fill", "reset", "remove", "add"], n, p=[0.9, 0.04, 0.02, 0.02, 0.02])})
    frames = [frame[k : k + 700] for k in range(0, n, 700)]
    made = {}
    for size in (n, 64):
        monkeypatch.setattr(indicators, "ROWS", size, raising=False)
        state = Held()
        parts = list(indicators.stream_indicators(Rows(), 5)(("A",), iter(frames), state))
        assert max(map(len, parts)) <= size
        made[size] = (pd.concat(parts, ignore_index=True), state.got)
    pd.testing.assert_frame_equal(made[n][0], made[64][0], check_exact=True)
    assert made[n][1] == made[64][1] and len(made[n][0]) > 1000


def test_slices_equal_whole_windows(spark):
    rows = [("A", t * t % 997, k, float(t)) for k, t in enumerate(range(0, 300, 7))] + [("B", 5, 100, 1.0), (None, 7, 101, 2.0)]
    df = spark.createDataFrame(rows, "k string, ts long, id long, v double")
    from pyspark.sql import Window

    for n in (1, 2, 5):
        whole = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(1 - n, 0)
        want = {r.id: (r.s, r.c) for r in df.select("id", F.sum("v").over(whole).alias("s"), F.count("*").over(whole).alias("c")).collect()}
        got = I.rolling_in_slices(df, ["k"], "ts", ["id"], n, 50, lambda w: {"s": F.sum("v").over(w), "c": F.count("*").over(w)})
        assert got.columns == [*df.columns, "s", "c"] and {r.id: (r.s, r.c) for r in got.collect()} == want
