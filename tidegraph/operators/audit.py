"""Audits of layers and cut-offs: overlaps, distributions, histograms, association."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.scalars import safe_corr


def membership(edges: DataFrame, groups: dict[str, str]) -> DataFrame:
    """One row per date and address with a 0/1 column for each named predicate; both endpoints of a row belong."""
    named = edges.select("date", *(F.expr(rule).alias(name) for name, rule in groups.items()), F.explode(F.array("from_addr", "to_addr")).alias("address"))
    flags = [F.max(F.coalesce(F.col(name), F.lit(False)).cast("int")).alias(name) for name in groups]
    return named.groupBy("date", "address").agg(*flags)


def overlap(members: DataFrame, a: str, b: str, empty: float | None = 0.0) -> DataFrame:
    """Sizes of two address sets per day, their intersection, Jaccard index and shares; ``empty`` where a denominator is 0."""
    n_a, n_b, both, either = (F.sum(x) for x in (F.col(a), F.col(b), F.col(a) * F.col(b), F.greatest(a, b)))

    def share(x: Column, of: Column) -> Column:
        return F.when(of > 0, x / of).otherwise(F.lit(empty).cast("double"))

    return members.groupBy("date").agg(
        n_a.alias("n_a"), n_b.alias("n_b"), both.alias("n_both"), share(both, either).alias("jaccard"), share(both, n_a).alias("share_of_a"), share(both, n_b).alias("share_of_b")
    )


def dual_activity(edges: DataFrame) -> DataFrame:
    """Addresses that move value and call contracts on the same day."""
    m = overlap(membership(edges, {"simple": "tx_value > 0", "contract": "tx_value = 0"}), "simple", "contract")
    names = ("n_simple_nodes", "n_contract_nodes", "n_dual_active", "dual_active_jaccard", "dual_active_frac_of_simple", "dual_active_frac_of_contract")
    return m.toDF("date", *names)


def described(rows: DataFrame, column: str, points: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99), by: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, max and exact percentiles."""
    x = F.col(column)
    quantiles = [F.percentile(x, F.lit(p)).alias(f"p{round(100 * p):02d}") for p in points]
    return rows.groupBy(*(by or [])).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), *quantiles)


def fraction(condition: Column) -> Column:
    """Share of rows that satisfy a condition; NULL counts as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def histogram(rows: DataFrame, column: str, width: float, low: float, high: float) -> DataFrame:
    """Counts in bins of equal width; the last bin includes its upper edge."""
    last = math.ceil((high - low) / width) - 1
    x = F.col(column)
    inside = rows.where(x.between(low, high))
    return inside.groupBy(F.least(F.floor((x - low) / width), F.lit(last)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def log_histogram(rows: DataFrame, column: str, low: float, high: float, edges: int = 40) -> DataFrame:
    """Counts between ``edges`` points spaced evenly in log10; the last bin includes its upper edge."""
    points = [low * (high / low) ** (i / (edges - 1)) for i in range(edges)]
    x = F.col(column).cast("double")
    inside = rows.where((x >= points[0]) & (x <= high))
    bin_ = F.least(sum((x >= F.lit(p)).cast("int") for p in points[1:]), F.lit(edges - 2))
    return inside.groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def right_closed_bins(rows: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Mean, median and count of y in bins (k width, (k+1) width] of x."""
    bin_ = (F.ceil(F.col(x) / width) - 1).cast("int")
    return rows.where(F.col(x) > 0).groupBy(bin_.alias("bin")).agg(F.avg(y).alias("mean"), F.percentile(y, F.lit(0.5)).alias("median"), F.count(y).alias("n"))


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(safe_corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("corr"), F.count("*").alias("n"))


def value_counts(rows: DataFrame, column: str, top: int | None = 15) -> DataFrame:
    counts = rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return counts.limit(top) if top else counts


def cramers_v(rows: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Association of two categorical columns; NULL with one row or one category on a side.

    Empty cells count: the statistic is n (sum of cell^2 / (row total * column total) - 1),
    which needs the occupied cells only.
    """
    by = by or []
    cells = rows.na.drop(subset=[a, b]).groupBy(*by, a, b).agg(F.count("*").alias("c"))
    on = by or None
    row = cells.groupBy(*by, a).agg(F.sum("c").alias("r"))
    column = cells.groupBy(*by, b).agg(F.sum("c").alias("k"))
    sizes = row.groupBy(*by).agg(F.sum("r").alias("n"), F.count("*").alias("n_a"))
    kinds = column.groupBy(*by).agg(F.count("*").alias("n_b"))
    phi = cells.join(row, [*by, a]).join(column, [*by, b]).groupBy(*by).agg((F.sum(F.col("c") * F.col("c") / (F.col("r") * F.col("k"))) - 1).alias("phi2"))
    joined = phi.join(sizes, on).join(kinds, on) if on else phi.crossJoin(sizes).crossJoin(kinds)  # one row each
    k = F.least("n_a", "n_b") - 1
    v = F.when((k > 0) & (F.col("n") > 1), F.sqrt(F.greatest("phi2", F.lit(0.0)) / k))
    return joined.select(*by, "n", v.alias("cramers_v"))


def entropy_of_sizes(rows: DataFrame, group: list[str], size: str) -> DataFrame:
    """-sum p ln(p + 1e-12) of the share of each size."""
    total = rows.groupBy(*group).agg(F.sum(size).alias("t"))
    p = F.col(size) / F.col("t")
    return rows.join(total, group).groupBy(*group).agg((-F.sum(p * F.log(p + 1e-12))).alias("entropy"))


def votes(rows: DataFrame, least: int = 2, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """Keys that at least ``least`` rows name."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_votes")).where(F.col("n_votes") >= least)


def progress(rows: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """How much of an output exists: rows, distinct keys, and rows with a NULL key."""
    missing = F.count_if(F.greatest(*(F.col(k).isNull() for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull())
    return rows.groupBy(*group).agg(F.count("*").alias("n_rows"), F.count_distinct(*(F.col(k) for k in keys)).alias("n_keys"), missing.alias("n_missing"))
