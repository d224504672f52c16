"""Time series: windows, statistics, periods, stitching. A series is (series_id, date, value)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.scalars import adjusted_kurtosis, adjusted_skewness, safe_corr

ID, DATE, VALUE = "series_id", "date", "value"


def along(rows: tuple[int, int] | None = None):
    w = Window.partitionBy(ID).orderBy(DATE)
    return w.rowsBetween(*rows) if rows else w


def difference(c: Column, lag: int = 1) -> Column:
    return c - F.lag(c, lag).over(along())


def trailing(c: Column, n: int, how=F.avg) -> Column:
    """Over the last n rows; NULL until there are n."""
    w = along((1 - n, 0))
    return F.when(F.count(c).over(w) == n, how(c).over(w))


def centred(c: Column, n: int, how, least: int) -> Column:
    """Over a window of n rows around each; an even window has one row more before than after."""
    w = along((-(n // 2), (n - 1) // 2))
    return F.when(F.count(c).over(w) >= least, how(c).over(w))


def centred_median(c: Column, n: int) -> Column:
    return F.percentile(c, F.lit(0.5)).over(along((-(n // 2), (n - 1) // 2)))


def short_autocorrelation(c: Column) -> Column:
    """Lag-one autocorrelation of three points: the sign of the product of their two differences, NULL if one is 0."""
    d = difference(c)
    sign = F.signum(d) * F.signum(F.lag(d).over(along()))
    return F.when(sign != 0, sign)


def filled(series: DataFrame) -> DataFrame:
    """Forward fill, then 0."""
    last = F.last(VALUE, ignorenulls=True).over(along((Window.unboundedPreceding, 0)))
    return series.withColumn(VALUE, F.coalesce(last, F.lit(0.0)))


def residuals(series: DataFrame, period: int = 7) -> DataFrame:
    """Value minus a centred rolling median and the median of each day of the week; trend and seasonal ride along."""
    s = filled(series)
    s = s.withColumn("trend", centred_median(F.col(VALUE), 2 * period + 1))
    s = s.withColumn("_d", F.col(VALUE) - F.col("trend"))
    seasonal = F.percentile("_d", F.lit(0.5)).over(Window.partitionBy(ID, F.weekday(DATE)))
    return s.withColumn("seasonal", seasonal).withColumn("residual", F.col("_d") - F.col("seasonal")).drop("_d")


def interpolated(series: DataFrame) -> DataFrame:
    """Missing values by time-weighted lines between neighbours, ends by the nearest value."""
    before, after = along((Window.unboundedPreceding, 0)), along((0, Window.unboundedFollowing))
    seen = F.when(F.col(VALUE).isNotNull(), F.struct(F.col(DATE).alias("d"), F.col(VALUE).alias("v")))
    s = series.withColumn("_a", F.last(seen, ignorenulls=True).over(before)).withColumn("_b", F.first(seen, ignorenulls=True).over(after))
    span, part = F.datediff("_b.d", "_a.d"), F.datediff(DATE, "_a.d")
    between = F.when(span > 0, F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * part / span).otherwise(F.col("_a.v"))
    value = F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(between)
    return s.withColumn(VALUE, value).drop("_a", "_b").where(F.col(VALUE).isNotNull())


def aligned(series: DataFrame) -> DataFrame:
    """Every series on every date of any, gaps interpolated."""
    dates, ids = series.select(DATE).distinct(), series.select(ID).distinct()
    grid = dates.crossJoin(ids)  # dates times series: the result itself
    return interpolated(grid.join(series, [ID, DATE], "left"))


def z_scores(c: Column, epsilon: float = 1e-8) -> Column:
    w = Window.partitionBy(ID)
    return (c - F.avg(c).over(w)) / (F.stddev_samp(c).over(w) + epsilon)


def statistics(series: DataFrame, by: list[str] | None = None) -> DataFrame:
    """19 figures of each series (and period): moments of the population, quantiles, autocorrelation, trend."""
    keys = [ID, *(by or [])]
    window = Window.partitionBy(*keys).orderBy(DATE)
    s = series.withColumns({"_1": F.lag(VALUE).over(window), "_7": F.lag(VALUE, 7).over(window), "_t": (F.row_number().over(window) - 1).cast("double")})
    x = F.col(VALUE)
    q = {p: F.percentile(x, F.lit(p / 100)) for p in (5, 25, 50, 75, 95)}
    spread = F.stddev_pop(x) > 0
    return s.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.var_pop(x).alias("variance"), F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("range"),
        F.when(spread, F.skewness(x)).alias("skewness"), F.when(spread, F.kurtosis(x)).alias("kurtosis"), (F.stddev_pop(x) / (F.avg(x) + 1e-12)).alias("cv"),
        *(v.alias(f"p{p:02d}") for p, v in q.items()), (q[75] - q[25]).alias("iqr"),
        safe_corr(x, F.col("_1")).alias("autocorr_1"), safe_corr(x, F.col("_7")).alias("autocorr_7"), F.regr_slope(x, F.col("_t")).alias("trend_slope"),
    )


def summary(series: DataFrame) -> DataFrame:
    """The yearly summary: sample moments, adjusted skewness and kurtosis, their tests' z values, coefficient of variation in percent."""
    x = F.col(VALUE)
    s = series.withColumns({"_1": F.lag(VALUE).over(along()), "_7": F.lag(VALUE, 7).over(along())})
    g = s.groupBy(ID).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.percentile(x, F.lit(0.25)).alias("q25"), F.percentile(x, F.lit(0.75)).alias("q75"), adjusted_skewness(x).alias("skewness"), adjusted_kurtosis(x).alias("kurtosis"),
        F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"), safe_corr(x, F.col("_1")).alias("autocorr_1"), safe_corr(x, F.col("_7")).alias("autocorr_7"),
    )
    n = F.col("n").cast("double")
    # D'Agostino's transformation of the skewness
    y = F.col("_g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta - 1))
    alpha = F.sqrt(2 / (w2 - 1))
    z_skew = F.log(y / alpha + F.sqrt(y * y / (alpha * alpha) + 1)) / F.sqrt(0.5 * F.log(w2))
    # Anscombe and Glynn's of the kurtosis
    e, v = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    d = (F.col("_g2") + 3 - e) / F.sqrt(v)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    inner = (1 - 2 / a) / (1 + d * F.sqrt(2 / (a - 4)))
    z_kurt = (1 - 2 / (9 * a) - F.signum(inner) * F.pow(F.abs(inner), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    enough = (n >= 20) & (F.col("std") > 0)
    return g.withColumns({"cv_percent": F.when(F.col("mean") != 0, 100 * F.col("std") / F.col("mean")), "z_skewness": F.when(enough, z_skew), "z_kurtosis": F.when(enough, z_kurt), "p_skewness": F.when(enough, normal_p(z_skew)), "p_kurtosis": F.when(enough, normal_p(z_kurt)), "iqr": F.col("q75") - F.col("q25")}).drop("_g1", "_g2")


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal z: a rational approximation of erfc, good to 1.2e-7 relative."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    #: The coefficients of the approximation.
    series = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    inner = F.lit(series[-1])
    for c in reversed(series[:-1]):
        inner = inner * t + c
    return t * F.exp(-x * x + inner)


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and its p-value by Royston's approximation (3 to 5000 values)."""
    x = np.sort(x)
    n = len(x)
    if n < 3 or x[-1] == x[0]:
        return 1.0, 1.0
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    norm = float(m @ m)
    u = 1 / math.sqrt(n)
    a = m / math.sqrt(norm)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, a[-1]], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
            phi = (norm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[[-2, 1]] = second, -second
        else:
            phi = (norm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
        a[[-1, 0]] = last, -last
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    w = min(w, 1.0)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        y = -math.log(gamma - math.log1p(-w)) if gamma > math.log1p(-w) else 99.0
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, log_n = math.log1p(-w) if w < 1 else -99.0, math.log(n)
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
    return w, 1 - normal.cdf((y - mean) / sd)


def normality(series: DataFrame, most: int = 5000) -> DataFrame:
    """Shapiro-Wilk's W and p-value of the first ``most`` values of each series."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(frame.sort_values(DATE)[VALUE].dropna().to_numpy(float)[:most])
        return pd.DataFrame({ID: frame[ID].iloc[:1].tolist(), "shapiro_w": [w], "shapiro_p": [p]})

    return series.select(ID, DATE, VALUE).groupBy(ID).applyInPandas(run, f"{ID} {series.schema[ID].dataType.simpleString()}, shapiro_w double, shapiro_p double")


def in_periods(series: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows with their periods (period_index, start, end), both ends inclusive, so a change point is in two.

    Periods are a handful by construction (bounded by the change points of one
    search), so the band join broadcasts them.
    """
    p = F.broadcast(periods)
    return series.join(p, (F.col(DATE) >= p["start"]) & (F.col(DATE) <= p["end"]))


def year_boundaries(rows: DataFrame, value: str) -> DataFrame:
    """Last value of a year beside the first of the next, for years that follow each other."""
    years = rows.groupBy(ID, F.year(DATE).alias("y")).agg(F.max_by(value, DATE).alias("last"), F.min_by(value, DATE).alias("first"), F.min(DATE).alias("date"))
    following = years.select(ID, (F.col("y") - 1).alias("y"), F.col("first").alias("next_first"), F.col("date").alias("next_date"))
    return years.join(following, [ID, "y"]).select(ID, F.col("next_date").alias(DATE), F.col("last").alias("before"), F.col("next_first").alias("after"))


def stitched(parts: DataFrame) -> DataFrame:
    """Yearly parts as one series; a date that occurs twice keeps its largest value."""
    return parts.groupBy(ID, DATE).agg(F.max(VALUE).alias(VALUE))


def runs_of_days(flags: DataFrame, by: list[str], gap: int = 1) -> DataFrame:
    """Flagged days merged into events: a new one begins where more than ``gap`` days lie between."""
    w = Window.partitionBy(*by).orderBy(DATE)
    opens = (F.datediff(DATE, F.lag(DATE).over(w)) > gap).cast("int")
    numbered = flags.select(*by, DATE).distinct().withColumn("event", F.sum(F.coalesce(opens, F.lit(1))).over(w))
    return numbered.groupBy(*by, "event").agg(F.min(DATE).alias("first_day"), F.max(DATE).alias("last_day"), F.count("*").alias("n_days"))


def nearest_to_median(series: DataFrame, k: int) -> DataFrame:
    """The k days of each series that lie nearest to its median."""
    off = F.abs(F.col(VALUE) - F.percentile(VALUE, F.lit(0.5)).over(Window.partitionBy(ID)))
    w = Window.partitionBy(ID).orderBy("_off", DATE)
    return series.withColumn("_off", F.round(off, 9)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_off", "_r")
