"""Tables between the steps of a job, and numbers for rows without a global sort."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a session on one machine alone may
    leave it unset and gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"veritable-{os.getuid()}-{os.getpid()}")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that every later step
    reads the same rows, whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on the keys, null equal to null; the keys come once."""
    other = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(other, same, how).drop(*(f"__{k}" for k in keys))


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "pos") -> DataFrame:
    """``name``: 1, 2, ... within ``keys`` (null is a value) by ``order``, nulls first. Rows are
    dealt to ranges of (keys, order); each range counts its rows per key, the counts before it
    add up to where it starts, and rows are ranked within their range. So a key may hold most
    of the table. Rows that are equal in ``order`` come in any order."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = df.repartitionByRange(*(F.asc_nulls_first(k) for k in keys), *(c.asc_nulls_first() for c in by))
    # written, so that counts and rows are of the same ranges
    rows = materialize(ranges.withColumn("__part", F.spark_partition_id()), "ranges")
    return _ranked(rows, keys, by, name)


def _ranked(rows: DataFrame, keys: list[str], by: list[Column], name: str) -> DataFrame:
    counts = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range that a key meets
    starts = counts.select(*keys, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*(c.asc_nulls_first() for c in by)))
    return join_same(rows, starts, [*keys, "__part"]).withColumn(name, (F.col("__start") + inside).cast("long")).drop("__part", "__start")
