"""Trailing sums over a stream of transfers (an extension; the batch form is in ``operators.ranking``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_pairs(stream: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Counts by pair and day; a day is final once the watermark has passed it."""
    w = F.window(time, "1 day")
    return stream.withWatermark(time, late).groupBy(w, "from_addr", "to_addr").agg(F.count("*").alias("tx_count")).select(F.to_date("window.start").alias("date"), "from_addr", "to_addr", "tx_count")


def trailing_pairs(stream: DataFrame, time: str = "ts", days: int = 7, late: str = "1 day") -> DataFrame:
    """Counts by pair over sliding windows of some days that move by one; state older than the watermark is evicted."""
    w = F.window(time, f"{days} days", "1 day")
    sums = stream.withWatermark(time, late).groupBy(w, "from_addr", "to_addr").agg(F.count("*").alias("trailing_sum"))
    return sums.select(F.date_sub(F.to_date("window.end"), 1).alias("date"), "from_addr", "to_addr", "trailing_sum")
