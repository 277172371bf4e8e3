"""Event-driven backtests: a cash ledger per run in `applyInPandas`, metrics in DataFrame algebra.

Cash ledger: a buy pays notional and fee, a sale returns notional less fee, short or long alike; equity is cash
plus position value. (Debiting longs without counting their value, or keeping a short's proceeds, would bend
the curve.) Runs are independent, so runs and parameter sets are the parallelism.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import workers_import_package
from .indicators import over, sma


class Account:
    """Cash, positions and fills of one run."""

    def __init__(self, cash: float, fee: float = 0.001, slippage: float = 0.0) -> None:
        self.cash, self.fee, self.slippage = cash, fee, slippage
        self.quantity: dict[str, float] = {}
        self.entry: dict[str, float] = {}
        self.price: dict[str, float] = {}
        self.fills: list[dict] = []
        self.pending: dict[int, tuple[str, float, float]] = {}
        self.placed = 0

    def place(self, symbol: str, quantity: float, limit: float) -> int:
        """A limit order that waits; its number, for cancel()."""
        self.placed += 1
        self.pending[self.placed] = (symbol, quantity, limit)
        return self.placed

    def cancel(self, number: int) -> bool:
        """Take back a waiting order; False if it does not wait any more."""
        return self.pending.pop(number, None) is not None

    def match(self, ts: int) -> list[int]:
        """Fill the waiting orders that the current prices reach, at those prices; a buy that cash does not cover waits on."""
        filled = []
        for number, (symbol, quantity, limit) in list(self.pending.items()):
            price = self.price.get(symbol)
            if price is not None and (price <= limit if quantity > 0 else price >= limit) and self.order(ts, symbol, quantity, limit=price):
                del self.pending[number]
                filled.append(number)
        return filled

    def equity(self) -> float:
        return self.cash + sum(q * self.price[s] for s, q in self.quantity.items())

    def order(self, ts: int, symbol: str, quantity: float, limit: float | None = None) -> bool:
        """Fill at once: a market order at the close moved by slippage, a limit order at its limit.

        quantity > 0 buys; a buy that cash does not cover is rejected. Closing part books its profit net of fee.
        """
        side = 1 if quantity > 0 else -1
        price = limit if limit is not None else self.price[symbol] * (1 + side * self.slippage)
        fee = abs(quantity) * price * self.fee
        if side > 0 and quantity * price + fee > self.cash + 1e-9:
            return False
        held, entry = self.quantity.get(symbol, 0.0), self.entry.get(symbol, 0.0)
        closed = min(abs(quantity), abs(held)) if held * quantity < 0 else 0.0
        pnl = closed * (price - entry) * (1 if held > 0 else -1) - (fee if closed else 0.0)
        left = held + quantity
        if held * quantity >= 0:
            self.entry[symbol] = (abs(held) * entry + abs(quantity) * price) / abs(left)
        elif abs(quantity) > abs(held):
            self.entry[symbol] = price
        self.quantity[symbol] = left
        self.cash -= quantity * price + fee
        self.fills.append({"ts": ts, "symbol": symbol, "side": side, "quantity": abs(quantity), "price": price, "fee": fee, "pnl": pnl, "closing": closed > 0})
        return True


Strategy = Callable[[Account, object], None]


class MovingAverageCross:
    """Buys with share of cash when the fast average crosses above the slow one, sells all when below."""

    def __init__(self, fast: int = 5, slow: int = 20, share: float = 0.95) -> None:
        self.fast, self.slow, self.share = fast, slow, share
        self.closes: dict[str, list[float]] = {}
        self.above: dict[str, bool] = {}

    def __call__(self, account: Account, bar) -> None:
        past = self.closes.setdefault(bar.symbol, [])
        past.append(bar.close)
        del past[: -self.slow]
        if len(past) < self.slow:
            return
        above = sum(past[-self.fast :]) / self.fast > sum(past) / self.slow
        before = self.above.get(bar.symbol)
        self.above[bar.symbol] = above
        held = account.quantity.get(bar.symbol, 0.0)
        if above and before is False and held <= 0:
            account.order(bar.ts, bar.symbol, account.cash * self.share / bar.close)
        elif not above and before and held > 0:
            account.order(bar.ts, bar.symbol, -held)


class Grid:
    """Buys a unit at each level that the price falls to below the centre, sells it one level up; recentres."""

    def __init__(self, levels: int = 5, spacing: float = 0.02, unit: float = 0.1) -> None:
        self.levels, self.spacing, self.unit = levels, spacing, unit
        self.centre: dict[str, float] = {}

    def __call__(self, account: Account, bar) -> None:
        centre = self.centre.setdefault(bar.symbol, bar.close)
        held = account.quantity.get(bar.symbol, 0.0)
        if bar.close <= centre * (1 - self.spacing) and held < self.levels * self.unit * account.equity() / centre:
            if account.order(bar.ts, bar.symbol, self.unit * account.equity() / bar.close, limit=centre * (1 - self.spacing)):
                self.centre[bar.symbol] = centre * (1 - self.spacing)
        elif bar.close >= centre * (1 + self.spacing):
            if held > 0:
                account.order(bar.ts, bar.symbol, -held / self.levels, limit=centre * (1 + self.spacing))
            self.centre[bar.symbol] = centre * (1 + self.spacing)


class Bar(NamedTuple):
    ts: int
    symbol: str
    close: float


RESULT = "ts long, equity double, cash double, fills int, pnl double, wins int, losses int, won double, lost double"


def simulate(bars: DataFrame, runs: Sequence[str], strategy: Callable[..., Strategy], cash: float = 10_000.0, fee: float = 0.001, slippage: float = 0.0, parameters: Sequence[str] = (), report: bool = False) -> DataFrame:
    """bars: runs, parameters, ts, symbol, close. One equity row a run and time, with that time's fills.

    Waiting orders are matched against new prices before the strategy acts. With report, also seconds (of the whole
    run) and error: a run that fails gives one row with its error in place of ending the job.
    """
    workers_import_package(bars.sparkSession)

    def ledger(frame) -> list[tuple]:
        frame = frame.sort_values(["ts", "symbol"], ignore_index=True)
        times, symbols, closes = (frame[k].tolist() for k in ("ts", "symbol", "close"))
        account = Account(cash, fee, slippage)
        act = strategy(**{p: frame[p].iloc[0].item() for p in parameters})
        out, done, at, n = [], 0, 0, len(times)
        while at < n:
            ts, start = times[at], at
            while at < n and times[at] == ts:
                account.price[symbols[at]] = closes[at]
                at += 1
            if account.pending:
                account.match(ts)
            for k in range(start, at):
                act(account, Bar(ts, symbols[k], closes[k]))
            now = account.fills[done:]
            done = len(account.fills)
            shut = [f["pnl"] for f in now if f["closing"]]
            out.append((int(ts), account.equity(), account.cash, len(now), sum(f["pnl"] for f in now), sum(p > 0 for p in shut), sum(p < 0 for p in shut), sum(p for p in shut if p > 0), sum(-p for p in shut if p < 0)))
        return out

    def work(frame):
        import time

        import pandas as pd

        began, error = time.perf_counter(), None
        try:
            out = ledger(frame)
        except Exception as e:
            if not report:
                raise
            out, error = [(None, None, None, 0, 0.0, 0, 0, 0.0, 0.0)], f"{type(e).__name__}: {e}"
        result = pd.DataFrame(out, columns=["ts", "equity", "cash", "fills", "pnl", "wins", "losses", "won", "lost"])
        result["ts"] = result["ts"].astype("Int64")
        if report:
            result["seconds"], result["error"] = time.perf_counter() - began, error
        for k in [*parameters, *runs][::-1]:
            result.insert(0, k, frame[k].iloc[0])
        return result

    kinds = {f.name: f.dataType.simpleString() for f in bars.schema}
    head = ", ".join(f"{k} {kinds[k]}" for k in [*runs, *parameters])
    return bars.groupBy(*runs, *parameters).applyInPandas(work, f"{head}, {RESULT}" + ", seconds double, error string" * report)


def drawdown(equity: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """equity with peak so far and drawdown (a share of the peak)."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return equity.withColumn("peak", F.max(value).over(w)).withColumn("drawdown", F.try_divide(F.col("peak") - F.col(value), F.col("peak")))


def metrics(equity: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "equity", start: float | None = None, periods: float | None = None) -> DataFrame:
    """total_return, max_drawdown and Sharpe by key: mean over population deviation of the bar returns, the
    first one 0, not annualised; with periods (bars a year) annual_return too."""
    w = Window.partitionBy(*keys).orderBy(ts)
    change = F.coalesce(F.try_divide(F.col(value), F.lag(value).over(w)) - 1, F.lit(0.0))
    rows = drawdown(equity, keys, ts, value).withColumn("ret", change)
    first = F.lit(start) if start is not None else F.min_by(value, ts)
    total = F.try_divide(F.max_by(value, ts), first) - 1
    out = [total.alias("total_return"), F.max("drawdown").alias("max_drawdown"), F.coalesce(F.try_divide(F.avg("ret"), F.stddev_pop("ret")), F.lit(0.0)).alias("sharpe"), F.count("*").alias("n_bars")]
    if periods is not None:
        out.append((F.pow(1 + total, F.lit(periods) / F.count("*")) - 1).alias("annual_return"))
    return rows.groupBy(*keys).agg(*out)


def trade_metrics(equity: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fills, wins, losses, win rate, profit factor (0 without a loss), mean win and loss from simulate()."""
    s = equity.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("fills", "wins", "losses", "pnl", "won", "lost")])
    rate = F.coalesce(F.try_divide(F.col("wins"), F.col("wins") + F.col("losses")), F.lit(0.0))
    return s.withColumns({"win_rate": rate, "profit_factor": F.coalesce(F.try_divide("won", "lost"), F.lit(0.0)), "avg_win": F.try_divide("won", "wins"), "avg_loss": F.try_divide("lost", "losses")})


def sweep(bars: DataFrame, runs: Sequence[str], strategy: Callable[..., Strategy], sets: Iterable[dict], **kwargs) -> DataFrame:
    """metrics and trade_metrics of every run under every parameter set, its seconds, and the error of one that failed."""
    sets = list(sets)
    names = list(sets[0])
    dealt = bars.withColumn("p", F.explode(F.array(*[F.struct(*[F.lit(s[n]).alias(n) for n in names]) for s in sets]))).select(*bars.columns, "p.*")
    equity = simulate(dealt, runs, strategy, parameters=names, report=True, **kwargs)
    keys = [*runs, *names]
    about = equity.groupBy(*keys).agg(F.max("seconds").alias("seconds"), F.max("error").alias("error"))
    return metrics(equity, keys).join(trade_metrics(equity, keys), keys).join(about, keys)


def cross_signals(bars: DataFrame, keys: Sequence[str], ts: str, close: str, fast: int = 5, slow: int = 20) -> DataFrame:
    """Rows where the fast average crosses the slow one: signal 1 above, -1 below."""
    w = over(keys, [ts])
    rows = bars.withColumns({"fast": sma(close, fast, w), "slow": sma(close, slow, w)}).withColumn("above", F.col("fast") > F.col("slow"))
    rows = rows.withColumn("before", F.lag("above").over(w))
    return rows.where("before is not null and above <> before").withColumn("signal", F.when(F.col("above"), 1).otherwise(-1)).drop("above", "before")


def first_touch(orders: DataFrame, ticks: DataFrame, key: str, ts: str, price: str, width: int) -> DataFrame:
    """When each limit order fills: buys at the first later tick at or below the limit, sells at or above.

    orders: id, key, side (1 or -1), placed, limit, until. Orders and ticks meet in time cells of width. A cell's
    extreme prices tell whether it can fill an order; of the cells wholly between placed and until the first that
    can does fill it, so an order asks three cells at most: its first one, that one, its last one. A cell answers all
    its orders by halving (n log n of its rows, no pairs); its ticks and orders are held at once, so width bounds memory.
    Prices and limits compare as doubles, NaN above all others.
    """
    workers_import_package(orders.sparkSession)
    cell = F.floor(F.col(ts) / width)
    first, last = F.floor(F.col("placed") / width), F.floor(F.col("until") / width)
    reach = ticks.groupBy(key, cell.alias("cell")).agg(F.min(price).alias("lo"), F.max(price).alias("hi"))
    spread = orders.withColumn("cell", F.explode(F.sequence(first, last)))
    fits = F.when(F.col("side") == 1, F.col("lo") <= F.col("limit")).otherwise(F.col("hi") >= F.col("limit"))
    near = spread.join(reach, [key, "cell"]).where(fits)
    inner = F.min(F.when((F.col("cell") > first) & (F.col("cell") < last), F.col("cell")))
    ends = [F.max(F.when(F.col("cell") == at, at)) for at in (first, last)]
    cells = near.groupBy(*orders.columns).agg(F.array_distinct(F.array_compact(F.array(*ends, inner))).alias("cells"))
    asked = cells.select("id", F.col(key).alias("key"), "side", "placed", "until", F.col("limit").cast("double").alias("limit"), F.explode("cells").alias("cell"))
    offered = ticks.select(F.col(key).alias("key"), cell.alias("cell"), F.col(ts).alias("t"), F.col(price).cast("double").alias("p")).where("t is not null and p is not null")

    def filled(asked, offered):
        import numpy as np
        import pandas as pd

        offered = offered.sort_values("t", ignore_index=True)
        t, price, limit = offered["t"].to_numpy(), in_order(offered["p"].to_numpy()), in_order(asked["limit"].to_numpy())
        start, end = (np.searchsorted(t, asked[c].to_numpy(), side="right") for c in ("placed", "until"))
        buys, at = asked["side"].to_numpy() == 1, np.maximum(start, end)
        for some, sign in ((buys, 1), (~buys, -1)):
            if some.any():
                at[some] = first_at_most(price if sign == 1 else ~price, start[some], at[some], limit[some] if sign == 1 else ~limit[some])
        hit = at < end
        return pd.DataFrame({"id": asked["id"].to_numpy()[hit], "filled": t[at[hit]]})

    kinds = f"id {asked.schema['id'].dataType.simpleString()}, filled {offered.schema['t'].dataType.simpleString()}"
    hits = asked.groupBy("key", "cell").cogroup(offered.groupBy("key", "cell")).applyInPandas(filled, kinds)
    return hits.groupBy("id").agg(F.min("filled").alias("filled"))


def in_order(x):
    """Integers that compare as doubles do in SQL: -0 equals 0, NaN is above all."""
    import numpy as np

    bits = (np.asarray(x, float) + 0.0).view(np.int64)
    return np.where(np.isnan(x), np.iinfo(np.int64).max, np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits))


def first_at_most(x, start, end, limit):
    """For each question the first place from start on, before end, whose x is at most limit; end if there is none."""
    import numpy as np

    least = [x]  # least[k][i]: of the 2 ** k values from i on
    while len(least[-1]) > 1 << (len(least) - 1):
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    at = start.copy()
    for k in range(len(least) - 1, -1, -1):
        fits = np.flatnonzero(at + (1 << k) <= end)
        over = fits[least[k][at[fits]] > limit[fits]]
        at[over] += 1 << k
    return at


def grid_levels(centres: DataFrame, centre: str, levels: int, spacing: float) -> DataFrame:
    """centres with level (-levels .. levels, without 0) and price = centre (1 + level spacing)."""
    steps = [i for i in range(-levels, levels + 1) if i]
    return centres.withColumn("level", F.explode(F.array(*map(F.lit, steps)))).withColumn("price", F.col(centre) * (1 + F.col("level") * spacing))


def first_breach(equity: DataFrame, keys: Sequence[str], ts: str, value: str, start: float, limit: float) -> DataFrame:
    """The first time that each key's drawdown from its initial equity exceeds limit."""
    return equity.where((start - F.col(value)) / start > limit).groupBy(*keys).agg(F.min(ts).alias("stopped"))


#: Price scenarios as phases of (kind, seconds, size); size is a share of the price.
SCENARIOS = {
    "range": [("range", 600, 0.01)],
    "uptrend": [("trend", 600, 0.05)],
    "downtrend": [("trend", 600, -0.05)],
    "pump_dump": [("range", 120, 0.005), ("pump", 180, 0.2), ("dump", 180, -0.25), ("range", 120, 0.01)],
    "gap": [("range", 200, 0.005), ("gap", 1, 0.05), ("range", 400, 0.005)],
    "recovery": [("dump", 200, -0.15), ("trend", 400, 0.12)],
    "flash_crash": [("range", 200, 0.005), ("dump", 30, -0.3), ("pump", 60, 0.35), ("range", 300, 0.01)],
}


def scenario_prices(spark, name: str, start: float = 100.0, seed: int = 1, noise: float = 0.0005) -> DataFrame:
    """t (seconds), phase, price of a scenario: closed forms per phase, noise by seed."""
    out, at = None, 0
    level = start
    for i, (kind, seconds, size) in enumerate(SCENARIOS[name]):
        share = (F.col("t") - at) / float(seconds)
        path = {"range": 1 + size * F.sin(share * 6.283185307179586), "gap": F.lit(1 + size)}.get(kind, 1 + size * share)
        part = spark.range(at, at + seconds).select(F.col("id").alias("t"), F.lit(i).alias("phase"), (F.lit(level) * path * (1 + noise * F.randn(seed + i))).alias("price"))
        out = part if out is None else out.unionByName(part)
        at, level = at + seconds, level * (1 if kind == "range" else 1 + size)
    return out


def random_walk(spark, n: int, start: float = 100.0, volatility: float = 0.001, seed: int = 1, chunk: int = 1 << 16) -> DataFrame:
    """t, price: exp of a running sum of normal steps, summed by chunks of steps first, so no task orders the series."""
    steps = spark.range(n).select(F.col("id").alias("t"), (F.sqrt(-2 * F.ln(_uniform(seed))) * F.cos(6.283185307179586 * _uniform(seed + 1)) * volatility).alias("step"), F.floor(F.col("id") / chunk).alias("chunk"))
    before = steps.groupBy("chunk").agg(F.sum("step").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = Window.partitionBy("chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return steps.join(before, "chunk").select("t", (F.lit(start) * F.exp(F.col("base") + F.sum("step").over(w))).alias("price"))


def _uniform(seed: int):
    """A number in (0, 1) from id and seed, the same in every task and run."""
    return (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 12) + 0.5) / float(1 << 52)


def sine_wave(spark, n: int, start: float = 100.0, size: float = 0.05, period: int = 100) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("t"), (F.lit(start) * (1 + size * F.sin(F.col("id") * 6.283185307179586 / period))).alias("price"))
