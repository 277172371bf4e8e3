"""Technical indicators.

Windows cover what a frame can say. Averages that feed on their own output (exponential, Wilder) are affine:
y = a x + b y'. They are folded per key over rows in order by `applyInPandas`, in chunks when asked: a chunk's
effect on the state is the pair (its own result from 0, b ** rows), so chunks run in parallel and only these
pairs are chained; a hot key then needs no single task. Warm-up values are null, never NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import workers_import_package


def over(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def full(w: WindowSpec, n: int, value: Column, warm: Column | None = None) -> Column:
    """value once n rows are there, before that warm (null)."""
    return F.when(F.row_number().over(w) >= n, value).otherwise(F.lit(None) if warm is None else warm)


def sma(x: str, n: int, w: WindowSpec) -> Column:
    """Simple average, null in the warm-up."""
    return full(w, n, F.avg(x).over(w.rowsBetween(1 - n, 0)))


def sma_partial(x: str, n: int, w: WindowSpec) -> Column:
    """Simple average over the rows there are."""
    return F.avg(x).over(w.rowsBetween(1 - n, 0))


def rolling_std(x: str, n: int, w: WindowSpec, warm_zero: bool = False) -> Column:
    """Population deviation; in the warm-up null, or 0."""
    return full(w, n, F.stddev_pop(x).over(w.rowsBetween(1 - n, 0)), F.lit(0.0) if warm_zero else None)


def sample_std(x: str, frame: WindowSpec) -> Column:
    """Sample deviation over a frame; 0 for one row."""
    return F.coalesce(F.stddev_samp(x).over(frame), F.lit(0.0))


def bollinger(x: str, n: int, k: float, w: WindowSpec) -> list[Column]:
    """upper, middle, lower."""
    mid, dev = sma(x, n, w), rolling_std(x, n, w)
    return [(mid + k * dev).alias("upper"), mid.alias("middle"), (mid - k * dev).alias("lower")]


def obv(close: str, volume: str, w: WindowSpec) -> Column:
    """On-balance volume; starts at the first volume."""
    before = F.lag(close).over(w)
    return F.when(before.isNull(), F.col(volume)).when(F.col(close) > before, F.col(volume)).when(F.col(close) < before, -F.col(volume)).otherwise(0)


def wma(x: str, n: int, w: WindowSpec) -> Column:
    """Linearly weighted average, the newest heaviest."""
    total = sum((F.lag(x, k).over(w) * (n - k) for k in range(1, n)), F.col(x) * n)
    return full(w, n, total / (n * (n + 1) / 2))


def momentum(x: str, n: int, w: WindowSpec) -> Column:
    return F.col(x) - F.lag(x, n).over(w)


def roc(x: str, n: int, w: WindowSpec) -> Column:
    """Rate of change in percent; null where the old value is 0."""
    return F.try_divide((F.col(x) - F.lag(x, n).over(w)) * 100, F.lag(x, n).over(w))


def prefix_sum(x: str, w: WindowSpec) -> Column:
    return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def delta_encode(x: str, w: WindowSpec) -> Column:
    """The first value, then differences; prefix_sum() undoes it."""
    return F.col(x) - F.coalesce(F.lag(x).over(w), F.lit(0))


# -- folds -----------------------------------------------------------------------------------


def affine(x, a: float, seed: int):
    """y[i] = a x[i] + (1 - a) y[i-1] from y[seed] = the mean of x[0..seed]; NaN before. x: without NaN."""
    import numpy as np
    import pandas as pd

    out = np.full(len(x), np.nan)
    if len(x) > seed:
        head = np.asarray(x[seed:], float).copy()
        head[0] = np.mean(x[: seed + 1])
        out[seed:] = pd.Series(head).ewm(alpha=a, adjust=False).mean()
    return out


def ema_values(x, n: int, seed_sma: bool):
    """Exponential average with alpha 2 / (n + 1): seeded by the first value, or by the first n values' mean."""
    a = 2 / (n + 1)
    return affine(x, a, n - 1 if seed_sma else 0)


def wilder(x, n: int, skip: int):
    """Wilder's average of x[skip:]: the mean of its first n, then (old (n - 1) + new) / n; NaN before."""
    import numpy as np

    out = np.full(len(x), np.nan)
    out[skip:] = affine(x[skip:], 1 / n, n - 1)
    return out


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[str], outputs: Sequence[str], fold) -> DataFrame:
    """df and double columns outputs: fold(frame of one key, in order) returns arrays by name; NaN becomes null."""
    workers_import_package(df.sparkSession)

    def work(frame):
        import numpy as np

        frame = frame.sort_values(list(order), ignore_index=True)
        for name, values in fold(frame).items():
            frame[name] = np.where(np.isnan(values), None, values).astype(object)
        return frame

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*keys).applyInPandas(work, fields + "".join(f", {o} double" for o in outputs))


def ema(df: DataFrame, keys, order, x: str, n: int, seed_sma: bool, out: str = "ema") -> DataFrame:
    return folded(df, keys, order, [out], lambda f: {out: ema_values(f[x].to_numpy(), n, seed_sma)})


def macd(df: DataFrame, keys, order, x: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd, signal (over macd's own tail), histogram."""

    def fold(f):
        import numpy as np

        v = f[x].to_numpy()
        line = ema_values(v, fast, True) - ema_values(v, slow, True)
        mark, start = np.full(len(v), np.nan), slow - 1
        if len(v) > start:
            mark[start:] = ema_values(line[start:], signal, True)
        return {"macd": line, "signal": mark, "histogram": line - mark}

    return folded(df, keys, order, ["macd", "signal", "histogram"], fold)


def rsi(df: DataFrame, keys, order, x: str, n: int = 14) -> DataFrame:
    """Wilder's relative strength; an average loss of 0 counts as a ratio of 100."""

    def fold(f):
        import numpy as np

        d = np.diff(f[x].to_numpy(), prepend=np.nan)
        gain, loss = wilder(np.where(d > 0, d, 0.0), n, 1), wilder(np.where(d < 0, -d, 0.0), n, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(loss == 0, 100.0, gain / loss)
        return {"rsi": np.where(np.isnan(gain), np.nan, 100 - 100 / (1 + ratio))}

    return folded(df, keys, order, ["rsi"], fold)


def atr(df: DataFrame, keys, order, high: str, low: str, close: str, n: int = 14) -> DataFrame:
    """Wilder's average true range, from the second row on."""

    def fold(f):
        import numpy as np

        before = f[close].shift(1).to_numpy()
        true = np.fmax(f[high] - f[low], np.fmax((f[high] - before).abs(), (f[low] - before).abs())).to_numpy()
        return {"atr": wilder(true, n, 1)}

    return folded(df, keys, order, ["atr"], fold)


def ema_in_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, n: int, rows: int, out: str = "ema") -> DataFrame:
    """First-value-seeded average of keys of any length: chunks of so many rows in parallel, then chained.

    A chunk's row i is u[i] + b ** (i + 1) times the state before the chunk; the states need one row a chunk.
    """
    a = 2 / (n + 1)
    b = 1 - a
    w = over(keys, order)
    numbered = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__chunk", F.floor(F.col("__i") / rows).cast("long"))

    def local(f):
        import numpy as np
        import pandas as pd

        head = f[x].to_numpy(float) * (1 if f["__i"].iloc[0] == 0 else a)
        v = np.concatenate([head[:1], f[x].to_numpy(float)[1:]])
        return {"__u": pd.Series(v).ewm(alpha=a, adjust=False).mean().to_numpy()}

    part = folded(numbered, [*keys, "__chunk"], order, ["__u"], local)
    ends = part.groupBy(*keys, "__chunk").agg(F.max_by("__u", "__i").alias("u"), F.count("*").alias("k"))
    chain = folded(ends, keys, ["__chunk"], ["__before"], lambda f: {"__before": chained(f["u"].to_numpy(), f["k"].to_numpy(), b)})
    both = part.join(chain.select(*keys, "__chunk", "__before"), [*keys, "__chunk"])
    value = F.col("__u") + F.pow(F.lit(b), F.col("__i") % rows + 1) * F.col("__before")
    return both.select(*df.columns, F.when(F.col("__chunk") == 0, F.col("__u")).otherwise(value).alias(out))


def chained(u, k, b: float):
    """The state before each chunk, from each chunk's own end result u and its length k; 0 before the first."""
    import numpy as np

    out, state = np.zeros(len(u)), 0.0
    for i in range(len(u)):
        out[i] = state
        state = u[i] + (b ** k[i] * state if i else 0.0)
    return out


def rolling_in_slices(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], rows: int, width: int, aggregates: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """df with aggregates over each row and the rows - 1 before it, for tables with few keys of very many rows.

    A key is cut into slices of width (of ts), each one window of its own, so no task orders a whole key. Before its
    own rows a slice gets the last rows - 1 of its key's earlier slices: each of these has a row at least, so the ends of
    that many slices are enough, and only those ends meet in a window by key.
    """
    order = F.struct(ts, *tie)
    cut = df.select(F.struct(*df.columns).alias("row"), *keys, order.alias("at"), F.floor(F.col(ts) / width).alias("slice"))
    own = [*keys, "slice"]
    last = cut.withColumn("back", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("at")))).where(F.col("back") < rows)
    ends = last.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("at", "row"))).alias("end"))  # rows - 1 at most
    if rows > 1:
        before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(1 - rows, -1)
        halo = ends.withColumn("halo", F.flatten(F.collect_list("end").over(before))).select(*own, F.explode(F.slice("halo", F.greatest(F.lit(1), F.size("halo") - rows + 2), rows - 1)).alias("h")).select(*own, "h.at", "h.row", F.lit(False).alias("mine"))
        cut = cut.withColumn("mine", F.lit(True)).unionByName(halo)
    else:
        cut = cut.withColumn("mine", F.lit(True))
    w = Window.partitionBy(*own).orderBy("at").rowsBetween(1 - rows, 0)
    made = aggregates(w)
    opened = cut.select("mine", *own, "at", *[F.col("row")[c].alias(c) for c in df.columns if c not in keys])
    return opened.withColumns(made).where("mine").select(*df.columns, *made)
