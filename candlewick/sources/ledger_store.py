"""Trades and equity of backtests and accounts, as Parquet by UTC day.

A query's days are literals of the partition column, so only their folders are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import time_label
from ..schema import EQUITY, TRADE

KINDS = {"trades": TRADE, "equity": EQUITY}


class LedgerStore:
    """Two tables under one path; times are epoch milliseconds."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, kind: str, rows: DataFrame) -> None:
        """rows with the columns of schema.TRADE or schema.EQUITY."""
        dealt = rows.select(*KINDS[kind].names).withColumn("day", time_label(F.col("timestamp")))
        dealt.repartition("day").sortWithinPartitions("timestamp").write.mode("append").partitionBy("day").parquet(f"{self.path}/{kind}")

    def query(self, kind: str, start: int, end: int, where=None, limit: int | None = None) -> DataFrame:
        """Rows of [start, end) for which where holds, newest first where there is a limit, else in time order."""
        at = F.col("timestamp")
        df = self.spark.read.schema(T.StructType([*KINDS[kind].fields, T.StructField("day", T.StringType())])).parquet(f"{self.path}/{kind}")
        df = df.where((at >= start) & (at < end) & F.col("day").between(time_label(F.lit(start)), time_label(F.lit(end))))
        df = df if where is None else df.where(where)
        df = df.drop("day")
        return df.orderBy(at) if limit is None else df.orderBy(at.desc()).limit(limit)

    def summary(self, start: int, end: int) -> DataFrame:
        """By symbol: trades, profit, fees, and the share of trades with a profit."""
        t = self.query("trades", start, end)
        return t.groupBy("symbol_id").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"), F.sum("fee").alias("fee"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))
