"""Daily topology: weighted graphs to distance matrices, persistence, features, and distances between days.

One task works on one (run, layer, date) group. Before that, edges are already
cut to ranked nodes and summed by pair, so a group is a small graph; the node
cap is a parameter. Both dimensions are complete at every size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.clouds import cloud_diagram
from tidegraph.operators.graphs import Graph, spread
from tidegraph.operators.homology import diagram, diagram_distance

POINTS = "array<struct<dim:int,birth:double,death:double>>"


def distances_of(weights: np.ndarray, how: str = "norm_similarity", alpha: float = 9.0) -> np.ndarray:
    """Weights to lengths: strong edges are short."""
    if how == "norm_similarity":
        low, high = weights.min(), weights.max()
        if high == low:
            return np.ones_like(weights)
        return 1 / (1 + alpha * (weights - low) / (high - low))
    if how == "i/log":
        return 1 / np.log1p(weights)
    raise ValueError(f"unknown distance {how!r}; known: norm_similarity, i/log")


def capped(g: Graph, most: int) -> Graph:
    """The subgraph of the ``most`` nodes of highest weighted degree, ties by name."""
    if g.n <= most:
        return g
    order = np.lexsort((np.arange(g.n), -np.round(g.strength(), 9)))
    return g.subgraph(order[:most])


def all_pairs(g: Graph, lengths: np.ndarray) -> np.ndarray:
    """Shortest path lengths between all nodes; inf between components. Works component by component."""
    d = np.full((g.n, g.n), np.inf)
    np.minimum.at(d, (g.u, g.v), lengths)
    np.minimum.at(d, (g.v, g.u), lengths)
    np.fill_diagonal(d, 0.0)
    label = g.components()
    for c in np.unique(label):
        members = np.flatnonzero(label == c)
        if len(members) < 3:
            continue
        part = d[np.ix_(members, members)]
        for k in range(len(members)):
            np.minimum(part, part[:, k, None] + part[k], out=part)
        d[np.ix_(members, members)] = part
    return d


def scaled(d: np.ndarray) -> np.ndarray:
    """Disconnected pairs at twice the largest finite length, then everything over the largest."""
    finite = d[np.isfinite(d)]
    top = finite.max() if len(finite) else 0.0
    out = np.where(np.isfinite(d), d, 2 * top)
    return out / out.max() if out.max() > 0 else out


def densified(g: Graph, how: str = "norm_similarity", alpha: float = 9.0) -> tuple[np.ndarray, list[list[int]]]:
    """The distance matrix in [0, 1] of a graph, and its neighbour lists."""
    d = scaled(all_pairs(g, distances_of(g.w, how, alpha)))
    near: list[list[int]] = [[] for _ in range(g.n)]
    for a, b in zip(g.u.tolist(), g.v.tolist()):
        if a != b:
            near[a].append(b)
            near[b].append(a)
    return d, near


def daily_diagrams(pairs: DataFrame, group: list[str], max_nodes: int = 500, how: str = "norm_similarity", alpha: float = 9.0, least_rows: int = 3) -> DataFrame:
    """group, n_nodes, n_edges, dgm of every group with enough rows and three nodes."""
    keys = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in group)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        head = {k: frame[k].iloc[:1].tolist() for k in group}
        nothing = pd.DataFrame({**{k: [] for k in head}, "n_nodes": [], "n_edges": [], "dgm": []})
        if len(frame) < least_rows:
            return nothing
        frame = frame.sort_values(["a", "b"])
        g = capped(Graph(frame["a"], frame["b"], frame["weight"]), max_nodes)
        if g.n < 3 or not len(g.w):
            return nothing
        found = diagram(*densified(g, how, alpha))
        points = [{"dim": k, "birth": float(b), "death": float(e)} for k in (0, 1) for b, e in found[k]]
        return pd.DataFrame({**head, "n_nodes": [g.n], "n_edges": [len(g.w)], "dgm": [points]})

    return spread(pairs.select(*group, "a", "b", "weight"), group).groupBy(*group).applyInPandas(run, f"{keys}, n_nodes int, n_edges int, dgm {POINTS}")


def point_cloud_diagrams(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Persistence of Euclidean point clouds, one per group, distances over the largest; both dimensions at every size."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame.sort_values("key")[vector].to_numpy()).astype(float)
        found = cloud_diagram(x)
        points = [{"dim": k, "birth": float(b), "death": float(e)} for k in (0, 1) for b, e in found[k]]
        return pd.DataFrame({group: frame[group].iloc[:1].tolist(), "n_points": [len(x)], "dgm": [points]})

    kind = vectors.schema[group].dataType.simpleString()
    return spread(vectors, [group]).groupBy(group).applyInPandas(run, f"`{group}` {kind}, n_points int, dgm {POINTS}")


def lifetimes(dim: int | None = None, dgm: str = "dgm") -> Column:
    points = F.col(dgm) if dim is None else F.filter(dgm, lambda p: p["dim"] == dim)
    return F.transform(F.filter(points, lambda p: p["death"] < F.lit(float("inf"))), lambda p: p["death"] - p["birth"])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def largest(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0.0))


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values)).otherwise(0.0)


def quantile(values: Column, p: float) -> Column:
    """Linear interpolation between order statistics."""
    ordered = F.array_sort(values)
    at = (F.size(values) - 1) * p
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(values) - 1))
    return F.when(F.size(values) > 0, a + (b - a) * (at - low))


def persistence_features(diagrams: DataFrame) -> DataFrame:
    """Nine figures of each diagram's lifetimes, by higher-order functions on the array."""
    every, ones = lifetimes(), lifetimes(1)
    s = total(every)
    shares = F.transform(every, lambda x: x / (s + 1e-10))
    norm = total(shares)
    entropy = F.when((F.size(every) > 0) & (norm > 0), -total(F.transform(shares, lambda p: F.when(p > 0, p / norm * F.log(p / norm)).otherwise(0.0)))).otherwise(0.0)
    cut = quantile(ones, 0.75)
    m = mean(every)
    return diagrams.withColumns({
        "num_loops": F.size(ones), "avg_persistence": m, "max_persistence": largest(every), "persistence_entropy": entropy, "avg_loop_persistence": mean(ones), "max_loop_persistence": largest(ones),
        "loop_persistence_ratio": total(ones) / (s + 1e-10), "num_strong_loops": F.size(F.filter(ones, lambda x: x > cut)),
        "persistence_variance": mean(F.transform(every, lambda x: (x - m) * (x - m))),
    })


def daily_features(diagrams: DataFrame, compat: bool = False) -> DataFrame:
    """Counts, totals and maxima of both dimensions; with ``compat`` an empty dimension counts as one point."""
    zeros, ones = lifetimes(0), lifetimes(1)

    def count(x: Column) -> Column:
        return F.greatest(F.size(x), F.lit(1)) if compat else F.size(x)

    return diagrams.withColumns({
        "H0_num_components": count(zeros), "H0_total_persistence": total(zeros), "H0_max_persistence": largest(zeros),
        "H1_num_loops": count(ones), "H1_total_persistence": total(ones), "H1_max_persistence": largest(ones),
    })


def temporal_features(features: DataFrame, by: list[str], window: int = 3) -> DataFrame:
    """Changes, trailing mean and deviation, and short autocorrelation of the loops."""
    w = Window.partitionBy(*by).orderBy("date")
    tail = w.rowsBetween(1 - window, 0)
    x, n = F.col("H1_total_persistence"), F.col("H1_num_loops")
    d = x - F.lag(x).over(w)
    full = F.count(x).over(tail) == window
    out = features.withColumns({"H1_persistence_change": d, "H1_loop_change": n - F.lag(n).over(w), "H1_persistence_mean": F.when(full, F.avg(x).over(tail)), "H1_persistence_std": F.when(full, F.stddev_samp(x).over(tail))})
    sign = F.signum(F.round("H1_persistence_change", 12)) * F.signum(F.round(F.lag("H1_persistence_change").over(w), 12))
    return out.withColumn("H1_autocorr", F.when(sign != 0, sign))


def composite_indices(features: DataFrame, by: list[str]) -> DataFrame:
    """Connectivity, fragility and reflexivity from z-scores over each run."""
    w = Window.partitionBy(*by)
    names = ("H0_total_persistence", "H0_max_persistence", "H1_total_persistence", "H1_max_persistence")
    z = {f"{c}_z": (F.col(c) - F.avg(c).over(w)) / (F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0)) + 1e-8) for c in names}
    out = features.withColumns(z)
    return out.withColumns({
        "connectivity_index": F.col("H0_total_persistence_z") + F.col("H0_max_persistence_z"),
        "fragility_index": -(F.col("H1_total_persistence_z") + F.col("H1_max_persistence_z")),
        "reflexivity_index": F.coalesce("H1_autocorr", F.lit(0.0)) + F.coalesce("H1_persistence_change", F.lit(0.0)),
    })


def stacked(diagrams: DataFrame, by: list[str]) -> DataFrame:
    """Diagrams of several layers as one."""
    return diagrams.groupBy(*by).agg(F.flatten(F.collect_list("dgm")).alias("dgm"))


def as_arrays(points) -> dict[int, np.ndarray]:
    out: dict[int, list] = {}
    for p in points if points is not None else ():
        out.setdefault(int(p["dim"]), []).append((p["birth"], p["death"]))
    return {k: np.array(v, float) for k, v in out.items()}


def distance_series(diagrams: DataFrame, by: list[str], metric: str = "wasserstein") -> DataFrame:
    """by, date, distance to the previous day that has a diagram, and how many days lie between."""
    w = Window.partitionBy(*by).orderBy("date")
    rows = diagrams.select(*by, "date", "dgm", F.lag("dgm").over(w).alias("before"), F.datediff("date", F.lag("date").over(w)).alias("gap_days")).where("before IS NOT NULL")

    @F.pandas_udf("double")
    def between(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([diagram_distance(as_arrays(x), as_arrays(y), metric) for x, y in zip(a, b)], dtype=float)

    return spread(rows, [*by, "date"]).select(*by, "date", between("before", "dgm").alias("value"), "gap_days")


def boundary_distances(rows: DataFrame, metric: str = "wasserstein") -> DataFrame:
    """Distance between the diagrams ``before`` and ``after``."""

    @F.pandas_udf("double")
    def between(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([diagram_distance(as_arrays(x), as_arrays(y), metric) for x, y in zip(a, b)], dtype=float)

    return rows.withColumn("value", between("before", "after")).drop("before", "after")
