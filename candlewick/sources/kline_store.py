"""A store of bars: Parquet partitioned by interval and symbol bucket.

Reads add the bucket's predicate to a symbol's, so only its folder is scanned. Upserts rewrite the touched
partitions only (dynamic partition overwrite) from a staged copy, so no job reads what it overwrites.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import hash_bucket
from ..operators import dml
from ..operators.timeseries import latest_on, sample_by_interval
from ..schema import KLINE, canonical

KEYS = ("symbol", "interval", "timestamp")


class KlineStore:
    """Bars of schema.KLINE under one path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 100) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.select(*KLINE.names).withColumn("bucket", hash_bucket(F.col("symbol"), self.buckets))

    def _write(self, rows: DataFrame, path: str, mode: str) -> None:
        rows.repartition("interval", "bucket").sortWithinPartitions("symbol", "timestamp").write.mode(mode).partitionBy("interval", "bucket").option("partitionOverwriteMode", "dynamic").parquet(path)

    def read(self) -> DataFrame:
        schema = T.StructType([*KLINE.fields, T.StructField("bucket", T.IntegerType())])
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except Exception as e:  # an empty store has no folder yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def insert(self, rows: DataFrame) -> None:
        self._write(self._dealt(rows), self.path, "append")

    def _drop(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _replace(self, rows: DataFrame) -> None:
        """Overwrite the partitions of rows, from a copy of them, as rows may read those partitions."""
        stage = f"{self.path}.stage-{uuid.uuid4().hex}"
        self._write(rows, stage, "errorifexists")
        self._write(self.spark.read.schema(self.read().schema).parquet(stage), self.path, "overwrite")
        self._drop(stage)

    def upsert(self, rows: DataFrame, order=None) -> None:
        """New rows replace those of equal symbol, interval and timestamp; of several, the last by order (a column)."""
        new = self._dealt(rows)
        if order is not None:
            last = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*KLINE.names), order).alias("s")).select("s.*")
            new = self._dealt(last)
        touched = new.select("interval", "bucket").distinct()
        old = self.read().join(touched, ["interval", "bucket"], "left_semi").select(*new.columns)
        self._replace(dml.upsert(old, new, [*KEYS, "bucket"]))

    def upsert_newer(self, rows: DataFrame) -> None:
        """Keep only rows newer than the stored newest of their symbol and interval."""
        keys = ["symbol", "interval"]
        newest = self.read().groupBy(*keys).agg(F.max("timestamp").alias("newest"))
        fresh = rows.join(newest, keys, "left").where(F.col("newest").isNull() | (F.col("timestamp") > F.col("newest")))
        self.insert(fresh.select(*rows.columns))

    def query(self, symbol: str | None = None, interval: str | None = None, start: int | None = None, end: int | None = None, limit: int | None = None, newest_first: bool = False) -> DataFrame:
        """Bars in time order, both ends included."""
        df = self.read()
        if symbol is not None:
            # the bucket is computed by Spark from a literal and folded, so the partition filter prunes folders
            df = df.where((F.col("symbol") == symbol) & (F.col("bucket") == hash_bucket(F.lit(symbol), self.buckets)))
        if interval is not None:
            df = df.where(F.col("interval") == interval)
        if start is not None:
            df = df.where(F.col("timestamp") >= start)
        if end is not None:
            df = df.where(F.col("timestamp") <= end)
        df = df.drop("bucket").orderBy(F.desc("timestamp") if newest_first else F.asc("timestamp"))
        return df if limit is None else df.limit(limit)

    def latest(self) -> DataFrame:
        """The newest bar of each symbol and interval."""
        return latest_on(self.read(), ["symbol", "interval"], "timestamp", [c for c in KLINE.names if c not in KEYS])

    def sample_by(self, symbol: str, interval: str, columns: dict[str, list[str]], bucket: str = "1m") -> DataFrame:
        """Aggregates of a symbol's bars of one interval by bucket (an interval's name; one minute if not given)."""
        return sample_by_interval(self.query(symbol, canonical(interval)), "timestamp", bucket, columns, unit=1)

    def header(self) -> DataFrame:
        """What each file holds, without reading its values beyond time: path, bytes, rows, first and last time."""
        df = self.read().select("timestamp", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return df.groupBy("path", "bytes").agg(F.count("*").alias("n"), F.min("timestamp").alias("earliest"), F.max("timestamp").alias("newest"))

    def checksums(self) -> DataFrame:
        """Of each partition: rows, and the sum of the crc32 of each row; neither depends on files or order."""
        crc = F.crc32(F.to_json(F.struct(*KLINE.names), {"ignoreNullFields": "false"}))
        return self.read().groupBy("interval", "bucket").agg(F.count("*").alias("n"), F.sum(crc).alias("crc"))

    def verify(self, known: DataFrame) -> DataFrame:
        """The partitions whose checksums differ from known ones (of checksums()), lost and new ones included."""
        now = self.checksums().withColumnsRenamed({"n": "n_now", "crc": "crc_now"})
        return known.join(now, ["interval", "bucket"], "full").where(~(F.col("n").eqNullSafe(F.col("n_now")) & F.col("crc").eqNullSafe(F.col("crc_now"))))

    def tier(self, cold: KlineStore, before: int) -> None:
        """Move bars older than before (a timestamp) to another store: written there first, then deleted here."""
        cold.upsert(self.read().where(F.col("timestamp") < before).drop("bucket"))
        self.delete(F.col("timestamp") < before)

    def symbol_stats(self) -> DataFrame:
        return self.read().groupBy("symbol", "interval").agg(F.count("*").alias("n"), F.min("timestamp").alias("earliest"), F.max("timestamp").alias("newest"), F.avg("close").alias("avg_close"), F.min("low").alias("min_low"), F.max("high").alias("max_high"))

    def stats(self) -> DataFrame:
        return self.read().agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("interval").alias("intervals"))

    def delete(self, condition) -> None:
        """Rewrite the partitions that hold rows for which condition is true."""
        df = self.read()
        folders = ["interval", "bucket"]
        touched = df.where(condition).select(*folders).distinct()
        left = dml.delete(df.join(touched, folders, "left_semi"), condition)
        empty = touched.join(left.select(*folders).distinct(), folders, "left_anti").collect()  # folders, few
        self._replace(left.select(*df.columns))
        for r in empty:
            self._drop(f"{self.path}/interval={r.interval}/bucket={r.bucket}")

    def compact(self) -> None:
        """One sorted file a partition."""
        self._replace(self.read())

    def backup(self, path: str) -> None:
        self._write(self.read(), path, "overwrite")


def migrate(source: KlineStore, target: KlineStore) -> None:
    """Copy all bars."""
    target.upsert(source.read().drop("bucket"))
