"""Graphs of one group (layer, day) in NumPy, and centralities by name.

Relational steps (pair sums, degrees, strengths, ranks) are DataFrame plans; a
graph whose edges are already cut to the strongest ones is small, so everything
that walks it runs one group a task in an Arrow-backed function.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.layers import repaired
from tidegraph.operators.ranking import pruning_up_to


def undirected(edges: DataFrame, group: list[str], weight: str, loops: bool = True, repair: bool = False) -> DataFrame:
    """Pair sums with ordered ends: group, a, b, weight."""
    w = repaired(F.col(weight).cast("double")) if repair else F.col(weight).cast("double")
    rows = edges.na.drop(subset=["from_addr", "to_addr"])
    if not loops:
        rows = rows.where("from_addr <> to_addr")
    return rows.groupBy(*group, F.least("from_addr", "to_addr").alias("a"), F.greatest("from_addr", "to_addr").alias("b")).agg(F.sum(w).alias("weight"))


def strongest(pairs: DataFrame, group: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc(F.round("weight", 9)), "a", "b")
    return pruning_up_to(pairs, n).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def pruned(pairs: DataFrame, group: list[str], n: int) -> DataFrame:
    """Edges between the n nodes of highest unweighted degree."""
    degree = degrees(pairs, group)
    w = Window.partitionBy(*group).orderBy(F.desc("degree"), "address")
    best = degree.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select(*group, "address")
    for end in "ab":
        pairs = pairs.join(best.withColumnRenamed("address", end), [*group, end], "left_semi")
    return pairs


def degrees(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Degree and strength of every node; a loop counts twice."""
    ends = pairs.select(*group, "weight", F.explode(F.array("a", "b")).alias("address"))
    return ends.groupBy(*group, "address").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


class Graph:
    """An undirected weighted graph; nodes are numbered in sorted order."""

    def __init__(self, a, b, weight):
        names, flat = np.unique(np.concatenate([np.asarray(a, object), np.asarray(b, object)]).astype(str), return_inverse=True)
        self.names = names
        self.n = len(names)
        self.u, self.v = flat[: len(a)], flat[len(a) :]
        self.w = np.asarray(weight, float)
        src, dst, w = np.r_[self.u, self.v[self.u != self.v]], np.r_[self.v, self.u[self.u != self.v]], np.r_[self.w, self.w[self.u != self.v]]
        order = np.argsort(src, kind="stable")
        self.dst, self.dw = dst[order], w[order]
        self.start = np.searchsorted(src[order], np.arange(self.n + 1))

    def near(self, i: int):
        return self.dst[self.start[i] : self.start[i + 1]], self.dw[self.start[i] : self.start[i + 1]]

    def strength(self) -> np.ndarray:
        return np.bincount(self.u, self.w, self.n) + np.bincount(self.v, self.w, self.n)

    def degree(self) -> np.ndarray:
        return (np.bincount(self.u, minlength=self.n) + np.bincount(self.v, minlength=self.n)).astype(float)

    def dense(self, empty: float = 0.0) -> np.ndarray:
        m = np.full((self.n, self.n), empty)
        m[self.u, self.v] = m[self.v, self.u] = self.w
        return m

    def subgraph(self, keep: np.ndarray) -> Graph:
        mask = np.zeros(self.n, bool)
        mask[keep] = True
        e = mask[self.u] & mask[self.v]
        return Graph(self.names[self.u[e]], self.names[self.v[e]], self.w[e])

    def components(self) -> np.ndarray:
        label = np.arange(self.n)
        while True:
            low = np.minimum(label[self.u], label[self.v])
            before = label.copy()
            np.minimum.at(label, self.u, low)
            np.minimum.at(label, self.v, low)
            label = label[label]
            if (label == before).all():
                return label


def page_rank(g: Graph, alpha: float = 0.85, most: int = 300, tolerance: float = 1e-6) -> np.ndarray:
    out = np.bincount(np.r_[g.u, g.v[g.u != g.v]], np.r_[g.w, g.w[g.u != g.v]], g.n)
    x = np.full(g.n, 1 / g.n)
    src = np.repeat(np.arange(g.n), np.diff(g.start))
    share = np.divide(g.dw, out[src], out=np.zeros_like(g.dw), where=out[src] > 0)
    for _ in range(most):
        flow = np.bincount(g.dst, x[src] * share, g.n)
        new = alpha * (flow + x[out == 0].sum() / g.n) + (1 - alpha) / g.n
        if np.abs(new - x).sum() < g.n * tolerance:
            return new
        x = new
    raise ArithmeticError("page_rank did not converge")


def k_core(g: Graph) -> np.ndarray:
    if (g.u == g.v).any():
        raise ValueError("k_core needs a graph without loops")
    degree = g.degree().astype(int)
    core = degree.copy()
    queue = [(d, i) for i, d in enumerate(degree.tolist())]
    heapq.heapify(queue)
    done = np.zeros(g.n, bool)
    level = 0
    while queue:
        d, i = heapq.heappop(queue)
        if done[i] or d > degree[i]:
            continue
        done[i] = True
        level = max(level, d)
        core[i] = level
        for j in g.near(i)[0].tolist():
            if not done[j] and degree[j] > d:
                degree[j] -= 1
                heapq.heappush(queue, (degree[j], j))
    return core.astype(float)


def clustering(g: Graph) -> np.ndarray:
    """Geometric mean of the weights of a node's triangles, weights divided by the largest."""
    top = g.w.max()
    near = []
    for i in range(g.n):
        j, w = g.near(i)
        near.append({int(x): y / top for x, y in zip(j, w) if x != i})
    out = np.zeros(g.n)
    for i in range(g.n):
        mine = near[i]
        d = len(mine)
        if d < 2:
            continue
        keys = list(mine)
        total = 0.0
        for x, j in enumerate(keys):
            other = near[j]
            for k in keys[x + 1 :]:
                if k in other:
                    total += (mine[j] * mine[k] * other[k]) ** (1 / 3)
        out[i] = 2 * total / (d * (d - 1))
    return out


def hits(g: Graph, most: int = 300, tolerance: float = 1e-8) -> np.ndarray:
    """On an undirected graph hubs are authorities; normalised to sum 1."""
    src = np.repeat(np.arange(g.n), np.diff(g.start))
    x = np.full(g.n, 1 / g.n)
    for _ in range(most):
        authority = np.bincount(g.dst, x[src] * g.dw, g.n)
        new = np.bincount(g.dst, authority[src] * g.dw, g.n)
        new /= new.sum()
        if np.abs(new - x).sum() < tolerance:
            return new
        x = new
    raise ArithmeticError("hits did not converge")


def eigenvector(g: Graph, most: int = 500, tolerance: float = 1e-6) -> np.ndarray:
    """Power iteration, a dense solver where it does not settle; only connected graphs have one answer."""
    if len(np.unique(g.components())) > 1:
        raise ValueError("eigenvector centrality needs a connected graph")
    src = np.repeat(np.arange(g.n), np.diff(g.start))
    x = np.full(g.n, 1 / g.n)
    for _ in range(most):
        new = x + np.bincount(g.dst, x[src] * g.dw, g.n)
        new /= np.linalg.norm(new)
        if np.abs(new - x).sum() < g.n * tolerance:
            return new
        x = new
    values, vectors = np.linalg.eigh(g.dense())
    v = np.abs(vectors[:, values.argmax()])
    return v / np.linalg.norm(v)


def shortest_paths(g: Graph, source: int, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[int]]:
    """Dijkstra from one node: distances, path counts, predecessors, order of settling."""
    d = np.full(g.n, np.inf)
    sigma = np.zeros(g.n)
    before: list[list[int]] = [[] for _ in range(g.n)]
    d[source], sigma[source] = 0.0, 1.0
    settled: list[int] = []
    seen = np.zeros(g.n, bool)
    heap = [(0.0, source)]
    while heap:
        dist, i = heapq.heappop(heap)
        if seen[i]:
            continue
        seen[i] = True
        settled.append(i)
        for j, w in zip(g.dst[g.start[i] : g.start[i + 1]].tolist(), distance[g.start[i] : g.start[i + 1]].tolist()):
            new = dist + w
            if new < d[j] - 1e-15:
                d[j], sigma[j], before[j] = new, sigma[i], [i]
                heapq.heappush(heap, (new, j))
            elif abs(new - d[j]) <= 1e-15 and not seen[j]:
                sigma[j] += sigma[i]
                before[j].append(i)
    return d, sigma, before, settled


def _betweenness(g: Graph, pivots: int, seed: int, of_edges: bool):
    sources = np.arange(g.n) if g.n <= pivots else np.sort(np.random.default_rng(seed).choice(g.n, pivots, replace=False))
    nodes = np.zeros(g.n)
    pairs: dict[tuple[int, int], float] = {(min(a, b), max(a, b)): 0.0 for a, b in zip(g.u.tolist(), g.v.tolist())}
    for s in sources.tolist():
        _, sigma, before, order = shortest_paths(g, s, g.dw)
        delta = np.zeros(g.n)
        for i in reversed(order):
            for j in before[i]:
                c = sigma[j] / sigma[i] * (1 + delta[i])
                delta[j] += c
                pairs[min(i, j), max(i, j)] += c
            if i != s:
                nodes[i] += delta[i]
    scale = g.n / len(sources)
    if of_edges:
        norm = scale / (g.n * (g.n - 1)) if g.n > 1 else 1.0
        return {k: v * norm for k, v in pairs.items()}
    return nodes * (scale / ((g.n - 1) * (g.n - 2)) if g.n > 2 else 1.0)


def betweenness(g: Graph, pivots: int = 200, seed: int = 42) -> np.ndarray:
    """Share of shortest paths through a node, weights as lengths; exact up to ``pivots`` nodes, else from as many seeded sources."""
    return _betweenness(g, pivots, seed, False)


def edge_betweenness(g: Graph, pivots: int = 200, seed: int = 42) -> dict[tuple[int, int], float]:
    return _betweenness(g, pivots, seed, True)


CENTRALITIES: dict[str, Callable[[Graph], np.ndarray]] = {
    "page_rank": page_rank,
    "degree": Graph.degree,
    "strength": Graph.strength,
    "k_core": k_core,
    "betweenness": betweenness,
    "hits_hub": hits,
    "hits_authority": hits,
    "eigenvector": eigenvector,
    "clustering": clustering,
}


def centrality(name: str) -> tuple[Callable[[Graph], np.ndarray], bool]:
    """The function behind a name, and whether edges are ranked (suffix ``_edge``)."""
    of_edges = name.endswith("_edge")
    base = name.removesuffix("_edge")
    if base not in CENTRALITIES:
        raise ValueError(f"unknown centrality {name!r}; known: {', '.join(sorted(CENTRALITIES))}, each also with _edge")
    return CENTRALITIES[base], of_edges


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups dealt over twice as many tasks as a shuffle has (the same number would be taken for the partitioning that is there).

    Their rows are few but their work is not, so adaptive execution must not merge the small partitions.
    """
    return rows.repartition(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def node_scores(pairs: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """group, metric, address, score from one graph per group; a metric that fails on a graph is left out, the others stay."""
    known = [(m, centrality(m)[0]) for m in metrics]
    keys = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in group)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        g = Graph(frame["a"], frame["b"], frame["weight"])
        parts = []
        for name, score in known:
            try:
                values = score(g)
            except (ArithmeticError, ValueError, np.linalg.LinAlgError):
                continue
            parts.append(pd.DataFrame({**{k: frame[k].iloc[0] for k in group}, "metric": name, "address": g.names, "score": values}))
        return pd.concat(parts) if parts else pd.DataFrame({**{k: frame[k].iloc[:0] for k in group}, "metric": [], "address": [], "score": []})

    return spread(pairs, group).groupBy(*group).applyInPandas(run, f"{keys}, metric string, address string, score double")


def edge_scores(pairs: DataFrame, scores: DataFrame, group: list[str]) -> DataFrame:
    """Each edge has the larger score of its ends; a missing one counts 0."""
    s = scores.select(*group, "metric", "address", "score")
    metrics = s.select(*group, "metric").distinct()
    ends = {e: s.select(*group, "metric", F.col("address").alias(e), F.col("score").alias(f"s_{e}")) for e in "ab"}
    rows = pairs.join(metrics, group).join(ends["a"], [*group, "metric", "a"], "left").join(ends["b"], [*group, "metric", "b"], "left")
    return rows.select(*group, "metric", "a", "b", F.greatest(F.coalesce("s_a", F.lit(0.0)), F.coalesce("s_b", F.lit(0.0))).alias("score"))


def edge_betweenness_scores(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Betweenness of the edges themselves: group, metric, a, b, score."""
    keys = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in group)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        g = Graph(frame["a"], frame["b"], frame["weight"])
        found = edge_betweenness(g)
        i, j = (np.array([e[c] for e in found], np.int64) for c in (0, 1))
        return pd.DataFrame({**{k: frame[k].iloc[0] for k in group}, "metric": "betweenness", "a": g.names[i], "b": g.names[j], "score": list(found.values())})

    return spread(pairs, group).groupBy(*group).applyInPandas(run, f"{keys}, metric string, a string, b string, score double")


def centrality_ranks(pairs: DataFrame, group: list[str], metrics: list[str], top_n: int) -> DataFrame:
    """Ranks by centrality: nodes get their place, ``_edge`` metrics the places of their edges."""
    plain = [m for m in metrics if not centrality(m)[1]]
    of_edges = [m.removesuffix("_edge") for m in metrics if centrality(m)[1]]
    projected = [m for m in of_edges if m != "betweenness"]
    scores = node_scores(pairs, group, sorted({*plain, *projected}))
    order = Window.partitionBy(*group, "metric").orderBy(F.desc(F.round("score", 12)), "address")
    nodes = scores.where(F.col("metric").isin(*plain)).withColumn("top_rank", F.row_number().over(order)).where(F.col("top_rank") <= top_n)
    out = nodes.select(*group, "metric", "address", "top_rank", F.col("top_rank").alias("bottom_rank"))
    if of_edges:
        e = edge_scores(pairs, scores.where(F.col("metric").isin(*projected)), group)
        if "betweenness" in of_edges:  # edges have one of their own; other metrics are projected from nodes
            e = e.unionByName(edge_betweenness_scores(pairs, group))
        w = Window.partitionBy(*group, "metric").orderBy(F.desc(F.round("score", 12)), "a", "b")
        top = e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
        ends = top.select(*group, F.concat("metric", F.lit("_edge")).alias("metric"), "rank", F.explode(F.array("a", "b")).alias("address"))
        out = out.unionByName(ends.groupBy(*group, "metric", "address").agg(F.min("rank").alias("top_rank"), F.max("rank").alias("bottom_rank")))
    return out


def efficient_centrality(sums: DataFrame, group: list[str], weights: list[str], metrics: list[str], top_n: int) -> DataFrame:
    """Top edges of each group first, then one graph and many metrics: metric names end in ``__<weight>``."""
    out = None
    for weight in weights:
        pairs = strongest(undirected(sums, group, weight, loops=False), group, top_n)
        ranks = centrality_ranks(pairs, group, metrics, top_n).withColumn("ranking_metric", F.concat("metric", F.lit(f"__{weight}"))).drop("metric")
        out = ranks if out is None else out.unionByName(ranks)
    return out


def global_centrality(sums: DataFrame, weight: str, metrics: list[str], top_n: int, nodes: int, start: str, end: str) -> DataFrame:
    """Ranks by centrality in one graph of a whole period, cut to the ``nodes`` of highest degree before it is built."""
    rows = sums.where(F.col("date").between(F.lit(start), F.lit(end))).withColumns({"start_date": F.lit(start).cast("date"), "end_date": F.lit(end).cast("date")})
    period = ["start_date", "end_date"]
    return centrality_ranks(pruned(undirected(rows, period, weight, loops=False), period, nodes), period, metrics, top_n)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that the session names; without one, lost rows could not be read again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return df.checkpoint()


def connected_components(pairs: DataFrame, group: list[str]) -> DataFrame:
    """group, address, component (its smallest address) for graphs of any size and shape.

    Each round a node takes the smallest label around it, then the label of the
    node that its label names: labels travel twice as far each round, also along a
    path. They only fall, so the rounds end by themselves.
    """
    both = checkpointed(pairs.select(*group, F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select(*group, F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = checkpointed(both.groupBy(*group, F.col("x").alias("address")).agg(F.least(F.min("x"), F.min("y")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("address", "y"), [*group, "y"]).groupBy(*group, F.col("x").alias("address")).agg(F.min("component").alias("near"))
        spread = checkpointed(labels.join(near, [*group, "address"], "left").select(*group, "address", "component", F.least("component", F.coalesce("near", "component")).alias("new")))
        named = spread.select(*group, "new").distinct().join(spread.select(*group, F.col("address").alias("new"), F.col("new").alias("jump")), [*group, "new"])
        step = checkpointed(spread.join(named, [*group, "new"], "left").select(*group, "address", "component", F.least("new", F.coalesce("jump", "new")).alias("new")))
        labels = step.select(*group, "address", F.col("new").alias("component"))
        if not step.where("new <> component").limit(1).count():
            return labels


def component_sizes(labels: DataFrame, group: list[str]) -> DataFrame:
    """Number of components, the largest and its share of the nodes."""
    sizes = labels.groupBy(*group, "component").agg(F.count("*").alias("size"))
    return sizes.groupBy(*group).agg(F.count("*").alias("n_components"), F.max("size").alias("largest"), (F.max("size") / F.sum("size")).alias("largest_frac"))


def fixed_page_rank(pairs: DataFrame, group: list[str], steps: int = 10, alpha: float = 0.85) -> DataFrame:
    """PageRank of graphs of any size by a fixed number of joins; nodes without edges do not occur."""
    both = pairs.select(*group, F.col("a").alias("x"), F.col("b").alias("y"), "weight").union(pairs.where("a <> b").select(*group, F.col("b").alias("x"), F.col("a").alias("y"), "weight"))
    out = both.groupBy(*group, "x").agg(F.sum("weight").alias("out"))
    links = both.join(out, [*group, "x"]).select(*group, "x", "y", (F.col("weight") / F.col("out")).alias("share"))
    size = out.groupBy(*group).agg(F.count("*").alias("n"))
    rank = out.join(size, group).select(*group, F.col("x").alias("address"), "n", (F.lit(1.0) / F.col("n")).alias("score"))
    for _ in range(steps):
        flow = links.join(rank.withColumnRenamed("address", "x"), [*group, "x"]).groupBy(*group, F.col("y").alias("address")).agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
        rank = rank.join(flow, [*group, "address"], "left").select(*group, "address", "n", (F.coalesce("flow", F.lit(0.0)) * alpha + (1 - alpha) / F.col("n")).alias("score"))
    return rank.drop("n")


