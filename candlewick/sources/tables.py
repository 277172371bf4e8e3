"""The driver's tables, and the tick and bar views over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeseries import ohlcv
from ..session import workers_import_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' times carry no zone
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the tables."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, user_id, id, ts (epoch ms), price from events."""
    workers_import_package(spark)
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "user_id", F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("value").alias("price"))


HOUR = 3_600_000


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars by symbol; volume counts ticks."""
    return ohlcv(ticks(spark, sf_dir).withColumn("one", F.lit(1)), "ts", "price", "one", HOUR, ["symbol"], ["id"])
