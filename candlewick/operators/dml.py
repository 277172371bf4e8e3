"""Inserts, merges, deletes and updates as DataFrame transformations; sources.kline_store writes them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table and rows; columns that rows lack are null."""
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Column | None = None, changes: Sequence[str] | None = None) -> DataFrame:
    """Rows replace those of equal key; of several new rows with one key the last by order wins.

    Without an order, several new rows of one key are an error, as Spark keeps no order of its own. changes: the
    columns that a row which meets an old one sets; the others keep their old values. One pre-aggregated group-by
    over both sides: no join, no window, no hot task.
    """
    rest = [c for c in table.columns if c not in keys]
    by = F.lit(0) if order is None else order
    kind = rows.select(by.alias("by")).schema["by"].dataType
    side = lambda df, new, rank: df.select(*keys, F.struct(*rest).alias("s"), F.lit(new).alias("new"), rank.alias("by"))
    both = side(table, 0, F.lit(None).cast(kind)).unionByName(side(rows, 1, by))
    of = lambda new: F.max_by(F.when(F.col("new") == new, F.col("s")), F.when(F.col("new") == new, F.struct("new", "by")))
    met = both.groupBy(*keys).agg(of(1).alias("fresh"), of(0).alias("old"), F.sum("new").alias("n"))
    fresh = F.col("fresh") if order is not None else F.when(F.col("n") > 1, F.raise_error(F.lit("several new rows of one key need an order"))).otherwise(F.col("fresh"))
    met = met.withColumn("fresh", fresh)
    keeps = set() if changes is None else set(rest) - set(changes)
    pick = lambda c: F.when(F.col("fresh").isNull() | F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(f"fresh.{c}")) if c in keeps else F.when(F.col("fresh").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"fresh.{c}"))
    return met.select(*keys, *[pick(c).alias(c) for c in rest]).select(*table.columns)


def newer_only(table: DataFrame, rows: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """table and those of rows that are newer than the table's newest of their key."""
    newest = table.groupBy(*keys).agg(F.max(ts).alias("__newest"))
    fresh = rows.join(newest, list(keys), "left").where(F.col("__newest").isNull() | (F.col(ts) > F.col("__newest"))).drop("__newest")
    return insert(table, fresh)


def delete(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def update(table: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Change columns where the condition is true."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def without(table: DataFrame, tombstones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that no tombstone names."""
    return table.join(tombstones.select(*keys).distinct(), list(keys), "left_anti")


def counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after, deleted: row counts."""
    both = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(after.select(F.lit(0).alias("b"), F.lit(1).alias("a")))
    return both.agg(F.sum("b").alias("before"), F.sum("a").alias("after")).withColumn("deleted", F.col("before") - F.col("after"))
