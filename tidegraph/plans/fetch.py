"""Fetching a keyed source range by range, and going on where an earlier run stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(ranges: DataFrame, done: DataFrame) -> DataFrame:
    """Ranges (lo, hi) that ``done`` does not hold."""
    return ranges.join(done.select("lo", "hi").distinct(), ["lo", "hi"], "left_anti")


def rows_of(source: DataFrame, ranges: DataFrame, key: str, low: int, step: int) -> DataFrame:
    """Source rows that lie in one of the ranges, with its bounds: ranges of one width are met by an equi join on their start."""
    start = (F.floor((F.col(key) - low) / step) * step + low).cast("bigint")
    return source.withColumn("lo", start).join(ranges, "lo")


def fetch(source: DataFrame, ranges: DataFrame, key: str, low: int, step: int, path: str, to_edges: Callable[[DataFrame], DataFrame]) -> int:
    """Append the edges of all pending ranges to ``path``, one folder a range; returns how many ranges were pending.

    A range is done if its folder holds a file. Folders are replaced whole, so a
    run that died between ranges can simply be started again.
    """
    spark = source.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    done = spark.read.parquet(path).select("lo", "hi").distinct() if there else ranges.limit(0)
    left = pending(ranges, done).select("lo", "hi")
    n = left.count()
    if n:
        rows = to_edges(rows_of(source, left, key, low, step))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lo", "hi").parquet(path)
    return n
