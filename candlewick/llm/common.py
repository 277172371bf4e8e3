"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are maximal runs of anything but ASCII white space; `bytes.split()` cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch between the JVM and Python workers.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
    # whole texts travel in these batches, so their size bounds a worker's memory; the plan reads these settings
    # when it runs, so they stay set for the session
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; on a cluster no machine's own folder will do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='candlewick-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, tag: str, **options: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path."""
    path = new_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs no recomputation."""
    return written_at(df, tag, **options)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of written_at that nothing will read again."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def name_of(column: str) -> str:
    """A column's name as F.col takes it, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def row_of(df: DataFrame) -> Column:
    """All columns of df as one struct `row`, so that their names clash with nothing."""
    return F.struct(*[F.col(name_of(c)) for c in df.columns]).alias("row")


def with_fields(df: DataFrame, keep: tuple[str, ...], added: str) -> StructType:
    """The schema of df's columns keep and of those added (DDL), whose names must differ."""
    more = StructType.fromDDL(added)
    if set(keep) & set(more.names):
        raise ValueError(f"columns to keep have the names of new ones: {sorted(set(keep) & set(more.names))}; keep them in a struct")
    return StructType([*df.select(*map(name_of, keep)).schema.fields, *more.fields])


def bucket_of(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo modulus; null ids count as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit(""))), F.lit(modulus)).cast("int")


def bunches(batches, keys: list[str]):
    """Tables of whole groups of rows with equal keys, and where each group starts, from batches that come sorted by keys.

    A table ends with the last group that a batch completes, so beyond a batch only one group is held.
    """
    import numpy as np
    import pyarrow as pa

    rest = None
    for batch in _and_end(batches):
        if batch is not None:
            now = pa.Table.from_batches([batch])
            rest = now if rest is None or not len(rest) else pa.concat_tables([rest, now]).combine_chunks()
        if rest is None or not len(rest):
            continue
        change = np.logical_or.reduce([(v := rest.column(k).to_numpy())[1:] != v[:-1] for k in keys])
        start = np.append(0, np.flatnonzero(change) + 1)
        end = len(rest) if batch is None else int(start[-1])
        if end:
            yield rest.slice(0, end), start[start < end]
        rest = rest.slice(end)


def groups(batches, keys: list[str]):
    """Tables of the rows of one key each, from batches that come sorted by keys; one group is held at a time."""
    for rows, start in bunches(batches, keys):
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(rows)], strict=True):
            yield rows.slice(a, b - a)


def _and_end(items):
    yield from items
    yield None
