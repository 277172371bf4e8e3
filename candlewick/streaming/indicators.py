"""Streaming indicators and bars.

Count windows are not event-time windows: each symbol keeps its last n values as state, and an update gives all
indicators at once. Rows of a micro-batch are taken in (ts, id) order. Bars are event-time windows with a
watermark; rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import workers_import_package

STATE = "n long, ema double, tail array<double>, off boolean"
COMMANDS = ("", "fill", "reset", "remove", "add")
ROWS = 50_000  # of a symbol, made and given at a time
OUT = "symbol string, ts long, id long, price double, sma double, ema double, std double, low double, high double"


def rolled(tail: list[float], prices: list[float], n: int, count: int, ema: float) -> tuple[list[tuple], int, float, list[float]]:
    """Indicators of each price after those in tail; the count, the average and the last n values after it."""
    import numpy as np

    a, averages = 2 / (n + 1), []
    for p in prices:
        ema = p if count == 0 else a * p + (1 - a) * ema
        count += 1
        averages.append(ema)
    x = np.array([*tail[-(n - 1) :], *prices] if n > 1 else prices, float)
    pad = np.concatenate([np.full(max(0, n - 1 - len(tail)), np.nan), x])
    w = np.lib.stride_tricks.sliding_window_view(pad, n)[-len(prices) :]
    out = zip(np.nanmean(w, 1).tolist(), averages, np.nanstd(w, 1).tolist(), np.nanmin(w, 1).tolist(), np.nanmax(w, 1).tolist(), strict=True)
    return list(out), count, ema, [*tail, *prices][-n:]


def extended(held, more):
    """held with more behind it, in place where the kinds allow; None stands for nothing held."""
    import numpy as np

    if held is None:
        return np.array(more)
    kind = np.result_type(held, more)
    if held.dtype != kind:
        held = held.astype(kind)
    at = len(held)
    held.resize(at + len(more), refcheck=False)
    held[at:] = more
    return held


def coded(command: str) -> int:
    if command not in COMMANDS:
        raise ValueError(f"unknown command: {command}")
    return COMMANDS.index(command)


def stream_indicators(rows: DataFrame, n: int, batch_order: tuple[str, str] = ("ts", "id"), periods: dict[str, int] | None = None) -> DataFrame:
    """rows: symbol, ts, id, price. Partial averages in the warm-up, the exponential average seeded by the first
    value, population deviation (0 for one row), least and largest of the last n (or periods[symbol]).

    A column `command`, if there is one, governs a symbol: `fill` takes a price without giving a row, `reset` forgets
    all before it, `remove` also gives nothing until `add`; null is an ordinary price. A worker holds a micro-batch's rows
    of one symbol as plain numbers (24 bytes a row, 8 for their order), all else ROWS at a time.
    """
    workers_import_package(rows.sparkSession)
    governed, own = "command" in rows.columns, periods or {}

    def update(key, frames: Iterator, state):
        import numpy as np
        import pandas as pd

        count, ema, tail, off = state.get if state.exists else (0, 0.0, [], False)
        tail, width = list(tail), own.get(key[0], n)
        held = dict.fromkeys([*batch_order, "ts", "id", "price"])
        what = None
        for frame in frames:
            for c, values in held.items():
                held[c] = extended(values, frame[c].to_numpy())
            if governed:
                what = extended(what, frame["command"].where(frame["command"].notna(), "").map(coded).to_numpy(np.int8))
        order = np.lexsort([held[c] for c in reversed(batch_order)])
        for begin in range(0, len(order), ROWS):
            some = order[begin : begin + ROWS]
            prices, kept, out, at = held["price"][some].tolist(), [], [], 0
            told = what[some] if governed else np.zeros(len(some), np.int8)
            for end in [*(np.flatnonzero(told[1:] != told[:-1]) + 1).tolist(), len(some)]:
                command = COMMANDS[told[at]]
                if command in ("", "fill"):
                    if not off:
                        got, count, ema, tail = rolled(tail, prices[at:end], width, count, ema)
                        if not command:
                            kept += range(at, end)
                            out += got
                else:
                    count, ema, tail, off = 0, 0.0, [], command == "remove"
                at = end
            given = some[kept]
            made = pd.DataFrame(out, columns=["sma", "ema", "std", "low", "high"], dtype=float)
            yield pd.concat([pd.DataFrame({"symbol": key[0], **{c: held[c][given] for c in ("ts", "id", "price")}}), made], axis=1)
        state.update((count, float(ema), [float(t) for t in tail], off))

    return rows.groupBy("symbol").applyInPandasWithState(update, OUT, STATE, "append", "NoTimeout")


def stream_ohlcv(rows: DataFrame, width: str, late: str) -> DataFrame:
    """rows: symbol, time (timestamp), id, price. Bars by symbol and window, emitted when the watermark passes."""
    order = F.struct("time", "id")
    bars = rows.withWatermark("time", late).groupBy("symbol", F.window("time", width)).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume"))
    return bars.select("symbol", F.unix_millis(F.col("window.start")).alias("bucket"), "open", "high", "low", "close", "volume")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source has, into Parquet; returns what was written."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def upsert_batches(stream: DataFrame, store, checkpoint: str) -> None:
    """Keyed merge of every micro-batch into a KlineStore; replaying a batch changes nothing."""
    query = stream.writeStream.foreachBatch(lambda df, _: store.upsert(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
