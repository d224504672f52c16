"""Ranks of addresses by their strongest edges, restriction to ranked addresses, trailing windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.layers import LAYERS, METRICS, in_layers, valid_combinations

#: Sums are compared after rounding, so the order of addition cannot break a tie.
DIGITS = 9


def layer_sums(edges: DataFrame, period: list[str], layers: dict[str, str] | None = None, measures: tuple[str, ...] = METRICS) -> DataFrame:
    """Measures by layer, period and pair; token identity is dropped, sums of nothing are 0."""
    rows = in_layers(edges.na.drop(subset=[*period, "from_addr", "to_addr"]), layers)
    return rows.groupBy("filter", *period, "from_addr", "to_addr").agg(*(F.round(F.coalesce(F.sum(m), F.lit(0)), DIGITS).alias(m) for m in measures))


def by_metric(sums: DataFrame, combinations: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per (metric, layer) combination that is valid."""
    wanted: dict[str, list[str]] = {}
    for metric, layer in valid_combinations() if combinations is None else combinations:
        wanted.setdefault(metric, []).append(layer)
    pairs = [F.when(F.col("filter").isin(*layers), F.struct(F.lit(m).alias("ranking_metric"), F.col(m).cast("double").alias("score"))) for m, layers in wanted.items()]
    exploded = sums.withColumn("_m", F.explode(F.array_compact(F.array(*pairs))))
    return exploded.drop(*METRICS).select("*", "_m.*").drop("_m")


LIMIT_THRESHOLD = "spark.sql.optimizer.windowGroupLimitThreshold"


def pruning_up_to(rows: DataFrame, n: int) -> DataFrame:
    """Spark prunes groups before a shuffle only up to a limit of the session (1000): raised to n, never lowered."""
    conf = rows.sparkSession.conf
    if 0 <= int(conf.get(LIMIT_THRESHOLD)) < n:
        conf.set(LIMIT_THRESHOLD, str(n))
    return rows


def top_edges(scored: DataFrame, group: list[str], n: int) -> DataFrame:
    """The n best edges of each group, ranks from 1; ties by endpoints. Spark prunes groups before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "from_addr", "to_addr")
    return pruning_up_to(scored, n).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def node_ranks(top: DataFrame, group: list[str]) -> DataFrame:
    """Best and worst rank of the edges at each address."""
    ends = top.select(*group, "rank", F.explode(F.array("from_addr", "to_addr")).alias("address")).where("address IS NOT NULL")
    return ends.groupBy(*group, "address").agg(F.min("rank").alias("top_rank"), F.max("rank").alias("bottom_rank"))


def daily_ranking(edges: DataFrame, top_n: int, layers: dict[str, str] | None = None, combinations: list[tuple[str, str]] | None = None) -> DataFrame:
    """address, filter, ranking_metric, top_rank, bottom_rank, date."""
    group = ["filter", "ranking_metric", "date"]
    scored = by_metric(layer_sums(edges, ["date"], layers), combinations)
    return node_ranks(top_edges(scored, group, top_n), group).select("address", "filter", "ranking_metric", "top_rank", "bottom_rank", "date")


def global_ranking(edges: DataFrame, top_n: int, start: str, end: str, layers: dict[str, str] | None = None, combinations: list[tuple[str, str]] | None = None) -> DataFrame:
    """The same over a whole period."""
    group = ["filter", "ranking_metric"]
    inside = edges.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    scored = by_metric(layer_sums(inside, [], layers), combinations)
    ranks = node_ranks(top_edges(scored, group, top_n), group)
    return ranks.select("address", "filter", "ranking_metric", "top_rank", "bottom_rank", F.lit(start).cast("date").alias("start_date"), F.lit(end).cast("date").alias("end_date"))


def not_yet(ranks: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ("filter", "ranking_metric", "date")) -> DataFrame:
    """What a run still has to compute: combinations without a row in the existing output."""
    return ranks.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def chosen_nodes(ranks: DataFrame, filters: list[str], metric: str, top: int | tuple[int, int], rank_col: str = "bottom_rank") -> DataFrame:
    """Addresses by the ceiling of a rank, or by a band (lo, hi]."""
    inside = ranks.where(F.col("filter").isin(*filters) & (F.col("ranking_metric") == metric))
    low, high = top if isinstance(top, tuple) else (0, top)
    inside = inside.where((F.col(rank_col) > low) & (F.col(rank_col) <= high))
    return inside.select("date", "address").distinct() if "date" in ranks.columns else inside.select("address").distinct()


def restricted(edges: DataFrame, daily: DataFrame, globally: DataFrame | None = None) -> DataFrame:
    """Edges with both ends among the day's nodes or the global ones. Two semi joins; no set is held in memory."""
    nodes = daily.select("date", "address")
    if globally is not None:
        nodes = nodes.unionByName(_on_every_date(edges, globally))
    nodes = nodes.distinct()
    for end in ("from_addr", "to_addr"):
        edges = edges.join(nodes.withColumnRenamed("address", end), ["date", end], "left_semi")
    return edges


def _on_every_date(edges: DataFrame, globally: DataFrame) -> DataFrame:
    """Only the dates on which a global node really occurs: an equi join, not a product."""
    seen = edges.select("date", F.explode(F.array("from_addr", "to_addr")).alias("address")).distinct()
    return seen.join(globally.select("address"), "address", "left_semi").select("date", "address")


def trailing_sums(edges: DataFrame, days: int = 7, measure: str = "tx_count") -> DataFrame:
    """Sums over the trailing calendar days for every date that has edges, pairs that are inactive on it included.

    Each row is sent to the days it counts for, which makes the range join an
    equi group; sums of a day are taken first, so a pair travels once a day.
    """
    daily = edges.groupBy("date", "from_addr", "to_addr").agg(F.sum(measure).alias("m"))
    spread = daily.withColumn("date", F.explode(F.expr(f"sequence(date, date_add(date, {days - 1}))")))
    sums = spread.groupBy("date", "from_addr", "to_addr").agg(F.sum("m").alias("trailing_sum"))
    return sums.join(edges.select("date").distinct(), "date", "left_semi")


def trailing_edges(edges: DataFrame, top_n: int = 750, days: int = 7, measure: str = "tx_count") -> DataFrame:
    """The day's edges between nodes of its top pairs by trailing sum."""
    scored = trailing_sums(edges, days, measure).withColumn("score", F.col("trailing_sum").cast("double"))
    top = top_edges(scored, ["date"], top_n)
    nodes = top.select("date", F.explode(F.array("from_addr", "to_addr")).alias("address")).distinct()
    return restricted(edges, nodes)


def coverage(ranks: DataFrame) -> DataFrame:
    """Dates and addresses that a rank table covers, by layer and metric."""
    return ranks.groupBy("filter", "ranking_metric").agg(F.count_distinct("date").alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("address").alias("n_addresses"))


def single_layer(layer: str, metric: str) -> tuple[dict[str, str], list[tuple[str, str]]]:
    return {layer: LAYERS[layer]}, [(metric, layer)]
