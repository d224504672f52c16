"""Ollivier-Ricci curvature of daily graphs, Ricci-flow communities, and persistence of curvature.

Curvature of an edge: 1 - W / d, with d the shortest path length between its ends
and W the exact transport cost between their neighbourhood measures. A measure
keeps ``mass`` at the node and spreads the rest over its neighbours in proportion
to exp(-length squared).
"""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.graphs import Graph, spread
from tidegraph.operators.homology import loops, spanning_forest, transport
from tidegraph.operators.topology import all_pairs, capped, distances_of


def edge_curvature(g: Graph, lengths: np.ndarray, mass: float = 0.5, until: float = math.inf) -> np.ndarray:
    """Curvature of each edge; loops get 0. Past the moment ``until`` (monotonic seconds) it raises TimeoutError."""
    d = all_pairs(g, lengths)
    near: list[dict[int, float]] = [{} for _ in range(g.n)]
    for a, b, w in zip(g.u.tolist(), g.v.tolist(), lengths.tolist()):
        if a != b:
            near[a][b] = min(w, near[a].get(b, np.inf))
            near[b][a] = min(w, near[b].get(a, np.inf))
    measures = []
    for i, others in enumerate(near):
        nodes = np.array(sorted(others), np.int64)
        spread = np.exp(-np.array([others[j] for j in nodes.tolist()]) ** 2)
        total = spread.sum()
        share = (1 - mass) * spread / total if total > 0 else np.full(len(nodes), (1 - mass) / max(len(nodes), 1))
        measures.append((np.append(nodes, i), np.append(share, mass if len(nodes) else 1.0)))
    out = np.zeros(len(g.w))
    for e, (a, b) in enumerate(zip(g.u.tolist(), g.v.tolist())):
        if time.monotonic() > until:
            raise TimeoutError
        if a != b and d[a, b] > 0:
            (x, p), (y, q) = measures[a], measures[b]
            out[e] = 1 - transport(d[np.ix_(x, y)], p, q) / d[a, b]
    return out


def curvature_scalars(g: Graph, kappa: np.ndarray, lengths: np.ndarray) -> dict[str, float]:
    weight = 1 / lengths
    return {
        "curvature_mean": float(kappa.mean()), "curvature_median": float(np.median(kappa)), "curvature_min": float(kappa.min()), "curvature_frac_negative": float((kappa < 0).mean()),
        "curvature_weighted_mean": float((weight * kappa).sum() / weight.sum()), "n_nodes": g.n, "n_edges": len(kappa),
    }


def ricci_flow(g: Graph, lengths: np.ndarray, steps: int = 10, mass: float = 0.5) -> np.ndarray:
    """Edge lengths after some steps of length -= curvature * length, rescaled to sum to the number of edges."""
    w = lengths.astype(float).copy()
    for _ in range(steps):
        w = np.maximum(w - edge_curvature(g, w, mass) * w, 1e-12)
        w *= len(w) / w.sum()
    return w


def modularity(g: Graph, label: np.ndarray, weights: np.ndarray) -> float | None:
    total = weights.sum()
    if total <= 0:
        return None
    strength = np.bincount(g.u, weights, g.n) + np.bincount(g.v, weights, g.n)
    inside = weights[label[g.u] == label[g.v]].sum() / total
    _, group = np.unique(label, return_inverse=True)
    return float(inside - ((np.bincount(group, strength) / (2 * total)) ** 2).sum())


def filtration_modularity(g: Graph, weights: np.ndarray, cutoffs: np.ndarray) -> np.ndarray:
    """Modularity of the components of the edges up to each cutoff (rising), among these edges.

    No kept edge leaves a component, so it is one minus the sum of squared shares
    of strength; joining two components adds twice the product of theirs. One
    sweep over the edges with a union-find; nan where nothing is kept.
    """
    parent, strength = list(range(g.n)), [0.0] * g.n

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = np.full(len(cutoffs), np.nan)
    squares = total = 0.0
    order = np.argsort(weights, kind="stable").tolist()
    at = 0
    for i, limit in enumerate(cutoffs.tolist()):
        while at < len(order) and weights[order[at]] <= limit:
            e = order[at]
            at += 1
            a, b, w = find(int(g.u[e])), find(int(g.v[e])), float(weights[e])
            if a != b:
                squares += 2 * strength[a] * strength[b]
                parent[b] = a
                strength[a] += strength[b]
            squares += 4 * w * (strength[a] + w)
            strength[a] += 2 * w
            total += w
        if total > 0:
            out[i] = 1 - squares / (4 * total * total)
    return out


def cut(g: Graph, weights: np.ndarray, steps: int = 50, drop: float = 0.01) -> tuple[float, np.ndarray] | None:
    """Communities by dropping edges heavier than a cutoff: the highest one, below the largest weight, after which modularity falls by more than ``drop`` of itself; else the one of largest modularity."""
    if not len(weights) or weights.max() <= weights.min():
        return None
    cutoffs = np.linspace(weights.min(), weights.max(), steps)
    q = filtration_modularity(g, weights, cutoffs)
    if np.isnan(q).all():
        return None
    with np.errstate(invalid="ignore", divide="ignore"):
        falls = (q[1:-1] > 1e-4) & (q[:-2] > q[1:-1]) & ((q[:-2] - q[1:-1]) / q[:-2] > drop)
    before = np.flatnonzero(falls)
    chosen = before[-1] if len(before) else np.flatnonzero(q == np.nanmax(q))[-1]
    keep = weights <= cutoffs[chosen]
    return float(cutoffs[chosen]), components_of(g.n, g.u[keep], g.v[keep])


def components_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def size_entropy(sizes: np.ndarray) -> float:
    p = sizes / sizes.sum()
    return float(-(p * np.log(p + 1e-12)).sum())


def _graph(frame: pd.DataFrame, max_nodes: int, how: str, alpha: float):
    frame = frame[frame["a"] != frame["b"]].sort_values(["a", "b"])
    if len(frame) < 2:
        return None
    g = capped(Graph(frame["a"], frame["b"], frame["weight"]), max_nodes)
    if g.n < 3 or len(g.w) < 2:
        return None
    return g, distances_of(g.w, how, alpha)


def _grouped(pairs: DataFrame, group: list[str], run, fields: str, extra: tuple[str, ...] = ()) -> DataFrame:
    keys = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in group)
    columns = [*group, *(f.split()[0] for f in fields.split(", "))]

    def body(frame: pd.DataFrame) -> pd.DataFrame:
        rows = run(frame)
        return pd.DataFrame([{**{k: frame[k].iloc[0] for k in group}, **r} for r in rows], columns=columns)

    return spread(pairs.select(*group, "a", "b", "weight", *extra), group).groupBy(*group).applyInPandas(body, f"{keys}, {fields}")


SCALARS = ("curvature_mean", "curvature_median", "curvature_min", "curvature_frac_negative", "curvature_weighted_mean")


def daily_curvature(pairs: DataFrame, group: list[str], max_nodes: int = 500, how: str = "norm_similarity", alpha: float = 9.0, seconds: float | None = None) -> DataFrame:
    """Scalars of each group. With ``seconds`` each group may take so long, and ``status`` says ok, timeout, or what failed; figures are null unless ok."""

    def run(frame):
        got = _graph(frame, max_nodes, how, alpha)
        if not got:
            return []
        g, lengths = got
        if seconds is None:
            return [curvature_scalars(g, edge_curvature(g, lengths), lengths)]
        try:
            return [curvature_scalars(g, edge_curvature(g, lengths, until=time.monotonic() + seconds), lengths) | {"status": "ok"}]
        except TimeoutError:
            status = "timeout"
        except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
            status = repr(e)
        return [dict.fromkeys(SCALARS) | {"n_nodes": g.n, "n_edges": len(g.w), "status": status}]

    fields = ", ".join(f"{c} double" for c in SCALARS) + ", n_nodes int, n_edges int"
    return _grouped(pairs, group, run, fields if seconds is None else f"{fields}, status string")


def edge_curvatures(pairs: DataFrame, group: list[str], max_nodes: int = 500, how: str = "norm_similarity", alpha: float = 9.0) -> DataFrame:
    """Curvature of every edge; join other edge attributes on (a, b)."""

    def run(frame):
        got = _graph(frame, max_nodes, how, alpha)
        if not got:
            return []
        g, lengths = got
        return [{"a": g.names[a], "b": g.names[b], "curvature": float(k)} for a, b, k in zip(g.u, g.v, edge_curvature(g, lengths))]

    return _grouped(pairs, group, run, "a string, b string, curvature double")


COMMUNITY = "n_components int, largest_component int, largest_component_frac double, component_entropy double, n_communities int, cutoff double, largest_community_frac double, community_size_std double, community_entropy double, modularity double, n_nodes int, n_edges int"


def communities(pairs: DataFrame, group: list[str], members: bool = False, max_nodes: int = 500, how: str = "norm_similarity", alpha: float = 9.0, steps: int = 10, least: int = 20) -> DataFrame:
    """Component figures of each group, and Ricci-flow communities of its largest component if that has ``least`` nodes; with ``members`` the community of each node instead."""

    def run(frame):
        got = _graph(frame, max_nodes, how, alpha)
        if not got:
            return []
        g, lengths = got
        label = g.components()
        kinds, sizes = np.unique(label, return_counts=True)
        row = {"n_components": len(kinds), "largest_component": int(sizes.max()), "largest_component_frac": float(sizes.max() / g.n), "component_entropy": size_entropy(sizes), "n_nodes": g.n, "n_edges": len(g.w)}
        found = None
        if sizes.max() >= least:
            main = label == kinds[sizes.argmax()]
            inside = main[g.u] & main[g.v]
            part = Graph(g.names[g.u[inside]], g.names[g.v[inside]], g.w[inside])
            found = cut(part, ricci_flow(part, lengths[inside], steps))
        if found is None:
            return [] if members else [row]
        cutoff, community = found
        if members:
            return [{"address": name, "community": int(c)} for name, c in zip(part.names, community)]
        _, counts = np.unique(community, return_counts=True)
        return [row | {"n_communities": len(counts), "cutoff": cutoff, "largest_community_frac": float(counts.max() / part.n), "community_size_std": float(counts.std()), "community_entropy": size_entropy(counts), "modularity": modularity(part, community, part.w)}]

    return _grouped(pairs, group, run, "address string, community int" if members else COMMUNITY)


def curvature_persistence(pairs: DataFrame, group: list[str], max_nodes: int = 500, how: str = "norm_similarity", alpha: float = 9.0) -> DataFrame:
    """Diagrams of the flag complex in which an edge enters at minus its curvature and every node at the smallest such value."""

    def run(frame):
        got = _graph(frame, max_nodes, how, alpha)
        if not got:
            return []
        g, lengths = got
        value = -edge_curvature(g, lengths)
        start = float(value.min())
        d = np.full((g.n, g.n), np.inf)
        np.minimum.at(d, (g.u, g.v), value)
        np.minimum.at(d, (g.v, g.u), value)
        np.fill_diagonal(d, start)
        forest, deaths = spanning_forest(d)
        ones = loops(d, forest)
        ones = ones[np.isfinite(ones).all(axis=1)]
        points = [{"dim": 0, "birth": start, "death": float(x)} for x in deaths] + [{"dim": 1, "birth": float(a), "death": float(b)} for a, b in ones]
        return [{"n_nodes": g.n, "n_edges": len(g.w), "dgm": points}]

    keys = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in group)

    def body(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**{k: frame[k].iloc[0] for k in group}, **r} for r in run(frame)], columns=[*group, "n_nodes", "n_edges", "dgm"])

    return pairs.select(*group, "a", "b", "weight").groupBy(*group).applyInPandas(body, f"{keys}, n_nodes int, n_edges int, dgm array<struct<dim:int,birth:double,death:double>>")


def incident_means(pairs: DataFrame, group: list[str], measure: str) -> DataFrame:
    """Mean of an edge measure over the edges at each node."""
    ends = pairs.select(*group, measure, F.explode(F.array("a", "b")).alias("address"))
    return ends.groupBy(*group, "address").agg(F.avg(measure).alias(f"mean_{measure}"))
