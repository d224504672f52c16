"""Whole runs as one plan: configurations are rows, years and layers are columns, days are groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.layers import condition
from tidegraph.operators import ranking, topology
from tidegraph.operators.graphs import undirected
from tidegraph.operators.ingest import daily_counts
from tidegraph.sources.documents import run_documents


@dataclass(frozen=True)
class Run:
    """One configuration: which layer, how its nodes are chosen, and how its graphs become matrices."""

    name: str
    layer: str
    metric: str = "tx_count"
    daily_top: int | tuple[int, int] = 750
    global_top: int = 0
    rank_col: str = "bottom_rank"
    max_nodes: int = 500
    how: str = "norm_similarity"
    alpha: float = 9.0


def selected(edges: DataFrame, run: Run, daily: DataFrame, globally: DataFrame | None = None) -> DataFrame:
    """The edges of a run: both ends ranked, then the layer's filter."""
    nodes = ranking.chosen_nodes(daily, [run.layer], run.metric, run.daily_top, run.rank_col)
    lasting = ranking.chosen_nodes(globally, [run.layer], run.metric, run.global_top, run.rank_col) if globally is not None and run.global_top else None
    kept = ranking.restricted(edges, nodes, lasting).where(condition(run.layer))
    return kept.withColumn("run", F.lit(run.name))


def diagrams(edges: DataFrame, runs: list[Run], daily: DataFrame, globally: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(run, date, dgm, ...) and (run, date, n_edges, n_nodes) of every run.

    Runs that share matrix parameters share one grouped stage, so a sweep is one
    job and not a loop of jobs.
    """
    found, counts = None, None
    by_shape: dict[tuple, list[Run]] = {}
    for r in runs:
        by_shape.setdefault((r.metric, r.max_nodes, r.how, r.alpha), []).append(r)
    for (metric, most, how, alpha), members in by_shape.items():
        rows = None
        for r in members:
            one = selected(edges, r, daily, globally)
            rows = one if rows is None else rows.unionByName(one)
        pairs = undirected(rows, ["run", "date"], metric, repair=True)
        part = topology.daily_diagrams(pairs, ["run", "date"], most, how, alpha)
        n = daily_counts(rows.withColumn("date", F.struct("run", "date"))).select("date.*", "n_edges", "n_nodes")
        found = part if found is None else found.unionByName(part)
        counts = n if counts is None else counts.unionByName(n)
    return found, counts


def features(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Daily features, their changes over time and the composite indices."""
    by = by or ["run"]
    return topology.composite_indices(topology.temporal_features(topology.daily_features(found), by), by)


def documents(edges: DataFrame, runs: list[Run], daily: DataFrame, globally: DataFrame | None = None, metric: str = "wasserstein") -> DataFrame:
    """One JSON document a run."""
    found, counts = diagrams(edges, runs, daily, globally)
    return run_documents(found.select("run", "date", "dgm"), topology.distance_series(found, ["run"], metric), counts)


def sweep(layers: list[str], daily_tops: list[int | tuple[int, int]], **fixed) -> list[Run]:
    """Every layer with every ceiling or band."""

    def label(top) -> str:
        return f"{top[0]}-{top[1]}" if isinstance(top, tuple) else str(top)

    return [Run(f"{layer}_top{label(top)}", layer, daily_top=top, **fixed) for layer in layers for top in daily_tops]


def missing(runs: list[Run], existing: DataFrame) -> list[Run]:
    """Runs whose name the output does not hold yet."""
    done = {r[0] for r in existing.select("run").distinct().collect()}  # as many rows as configurations
    return [r for r in runs if r.name not in done]
