"""Change points of a multivariate daily signal by penalised exact search.

The signal is one row per date, so the search is one task by meaning; it runs in
an Arrow-backed pandas function on the aligned series. The cost is the squared
error around segment means, from prefix sums; the optimum over all segmentations
with segments of at least ``least`` points is found by dynamic programming with
pruning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.series import DATE, ID, VALUE, aligned


def pelt(x: np.ndarray, penalty: float, least: int) -> list[int]:
    """Starts of the segments but the first, for the cheapest segmentation of rows of ``x``."""
    n = len(x)
    sums = np.vstack([np.zeros(x.shape[1]), np.cumsum(x, axis=0)])
    squares = np.r_[0.0, np.cumsum((x * x).sum(axis=1))]
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    previous = np.zeros(n + 1, np.int64)
    starts = np.array([0])
    for end in range(least, n + 1):
        fit = starts[end - starts >= least]
        if len(fit):
            d = sums[end] - sums[fit]
            cost = squares[end] - squares[fit] - (d * d).sum(axis=1) / (end - fit)
            total = best[fit] + cost + penalty
            at = int(total.argmin())
            best[end], previous[end] = total[at], fit[at]
            # a start that is already worse than the best without another penalty stays worse
            keep = np.ones(len(starts), bool)
            keep[: len(fit)] = best[fit] + cost <= best[end]
            starts = starts[keep]
        if np.isfinite(best[end]):
            starts = np.append(starts, end)
    if not np.isfinite(best[n]):
        return []
    out, end = [], n
    while end > 0:
        end = int(previous[end])
        if end > 0:
            out.append(end)
    return out[::-1]


def search(x: np.ndarray, low: int, high: int, least: int) -> tuple[list[int], float]:
    """Change points at the first penalty, from large to small, whose number lies in low..high; else the nearest to the middle."""
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std > 0, std, 1)
    tried: dict[float, list[int]] = {}

    def at(penalty):
        if penalty not in tried:
            tried[penalty] = pelt(z, penalty, least)
        return tried[penalty]

    grid = np.geomspace(200, 0.5, 40)
    above = None
    for i, penalty in enumerate(grid):
        found = at(float(penalty))
        if low <= len(found) <= high:
            return found, float(penalty)
        if len(found) > high:
            above = i
            break
    if above:
        for penalty in np.geomspace(grid[above - 1], grid[above], 80):
            found = at(float(penalty))
            if low <= len(found) <= high:
                return found, float(penalty)
    middle = (low + high) / 2
    penalty = min(tried, key=lambda p: (abs(len(tried[p]) - middle), -p))
    return tried[penalty], penalty


def change_points(series: DataFrame, low: int = 6, high: int = 9, least: int = 90) -> DataFrame:
    """change_point (date), penalty."""
    names = [r[0] for r in series.select(ID).distinct().orderBy(ID).collect()]  # one per run: a handful
    wide = aligned(series).groupBy(DATE).pivot(ID, names).agg(F.first(VALUE)).na.drop().withColumn("_all", F.lit(1))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(DATE)
        points, penalty = search(frame[names].to_numpy(float), low, high, least) if len(frame) >= 2 * least else ([], float("nan"))
        return pd.DataFrame({"change_point": frame[DATE].to_numpy()[points], "penalty": [penalty] * len(points)})

    return wide.groupBy("_all").applyInPandas(run, "change_point date, penalty double")


def periods(points: DataFrame, series: DataFrame) -> DataFrame:
    """period_index, start, end between change points; both ends inclusive, so neighbours share a date."""
    ends = series.agg(F.min(DATE).alias("lo"), F.max(DATE).alias("hi"))
    marks = points.select(F.col("change_point").alias("d")).union(ends.select("lo")).union(ends.select("hi")).distinct()
    w = Window.orderBy("d")  # a handful of change points
    return marks.select((F.row_number().over(w) - 1).cast("int").alias("period_index"), F.col("d").alias("start"), F.lead("d").over(w).alias("end")).where("end IS NOT NULL")
