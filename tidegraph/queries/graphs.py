"""Graphs, centralities, topology, curvature and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.functions.layers import condition
from tidegraph.operators import audit, curvature, graphs, ranking, topology
from tidegraph.operators import series as S
from tidegraph.plans import runs
from tidegraph.queries.base import USER_EDGES, canonical, query, rounded
from tidegraph.queries.relational import END, LAYER, RANKED, START, daily_ranks
from tidegraph.sources import documents
from tidegraph.sources.edges import ship_transactions, table

GROUP = ["date"]
PAIRS = f"""{USER_EDGES}, pairs AS (SELECT date, from_addr AS a, to_addr AS b, CAST(sum(tx_count) AS DOUBLE) AS weight FROM canon WHERE from_addr <> to_addr GROUP BY 1, 2, 3),
strong AS (SELECT date, a, b, weight FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(weight, 9) DESC, a, b) AS r FROM pairs) WHERE r <= 2000),
ends AS (SELECT date, a AS x, b AS y, weight FROM pairs UNION ALL SELECT date, b, a, weight FROM pairs)"""
#: Edges that a day's graph keeps for centralities, and nodes that a pruned one keeps: limits that the operators have by design.
TOP_EDGES, TOP_NODES = 2000, 500
TOPOLOGY_RUNS = [runs.Run("simple_top40", "simple_txs_ALL", daily_top=40, rank_col="top_rank"), runs.Run("contract_band", "contract_txs_ALL", daily_top=(0, 40), rank_col="top_rank")]


def pairs(spark, sf_dir):
    return graphs.undirected(canonical(spark, sf_dir), GROUP, "tx_count", loops=False)


def strong(spark, sf_dir):
    return graphs.strongest(pairs(spark, sf_dir), GROUP, TOP_EDGES)


@query("g03_undirected", f"WITH {USER_EDGES} SELECT date, from_addr AS a, to_addr AS b, round(sum(CASE WHEN total_gas_fees IS NULL OR total_gas_fees <= 0 THEN 1e-6 ELSE total_gas_fees END), 6) AS weight FROM canon GROUP BY 1, 2, 3")
def undirected(spark, sf_dir):
    return rounded(graphs.undirected(canonical(spark, sf_dir), GROUP, "total_gas_fees", repair=True))


@query("g02_pruned", f"""WITH {PAIRS}, e AS (SELECT date, a AS x FROM pairs UNION ALL SELECT date, b FROM pairs), d AS (SELECT date, x, row_number() OVER (PARTITION BY date ORDER BY count(*) DESC, x) AS r FROM e GROUP BY 1, 2)
SELECT p.date, a, b, weight FROM pairs p JOIN d d1 ON d1.date = p.date AND d1.x = a AND d1.r <= 500 JOIN d d2 ON d2.date = p.date AND d2.x = b AND d2.r <= 500""")
def pruned(spark, sf_dir):
    return graphs.pruned(pairs(spark, sf_dir), GROUP, TOP_NODES)


@query("g04_strongest", f"WITH {PAIRS} SELECT * FROM strong")
def strongest(spark, sf_dir):
    return strong(spark, sf_dir)


@query("g06_g07_degree_strength", f"WITH {PAIRS} SELECT date, x AS address, count(*) AS degree, sum(weight) AS strength FROM ends GROUP BY 1, 2")
def degree(spark, sf_dir):
    return graphs.degrees(pairs(spark, sf_dir), GROUP)


def _rank_sql(steps: int) -> str:
    s = f"""WITH {PAIRS}, o AS (SELECT date, x, sum(weight) AS o FROM ends GROUP BY 1, 2), n AS (SELECT date, count(*) AS n FROM o GROUP BY 1),
l AS (SELECT e.date, e.x, e.y, e.weight / o.o AS share FROM ends e JOIN o ON o.date = e.date AND o.x = e.x), r0 AS (SELECT date, x, 1.0 / n AS s, n FROM o JOIN n USING (date))"""
    for i in range(steps):
        s += f", r{i + 1} AS (SELECT r.date, r.x, 0.85 * coalesce(f, 0) + 0.15 / n AS s, n FROM r{i} r LEFT JOIN (SELECT l.date, y, sum(s * share) AS f FROM l JOIN r{i} q ON q.date = l.date AND q.x = l.x GROUP BY 1, 2) z ON z.date = r.date AND z.y = r.x)"
    return s + f" SELECT date, x AS address, round(s, 9) AS score FROM r{steps}"


@query("g05_page_rank_steps", _rank_sql(3))
def page_rank_steps(spark, sf_dir):
    return rounded(graphs.fixed_page_rank(pairs(spark, sf_dir), GROUP, 3), 9)


@query("g12_clustering", f"""WITH {PAIRS}, m AS (SELECT date, max(weight) AS m FROM pairs GROUP BY 1), t AS (SELECT e1.date, e1.x, pow((e1.weight / m) * (e2.weight / m) * (e3.weight / m), 1.0 / 3) AS t
FROM ends e1 JOIN ends e2 ON e2.date = e1.date AND e2.x = e1.x AND e2.y > e1.y JOIN ends e3 ON e3.date = e1.date AND e3.x = e1.y AND e3.y = e2.y JOIN m ON m.date = e1.date),
d AS (SELECT date, x, count(*) AS d FROM ends GROUP BY 1, 2), s AS (SELECT date, x, sum(t) AS s FROM t GROUP BY 1, 2)
SELECT d.date, d.x AS address, round(CASE WHEN d >= 2 THEN 2 * coalesce(s, 0) / (d * (d - 1)) ELSE 0 END, 6) AS score FROM d LEFT JOIN s ON s.date = d.date AND s.x = d.x""")
def clustering(spark, sf_dir):
    return rounded(graphs.node_scores(pairs(spark, sf_dir), GROUP, ["clustering"]).drop("metric"))


@query("g05_g16_node_scores")
def node_scores(spark, sf_dir):
    return rounded(graphs.node_scores(strong(spark, sf_dir), GROUP, list(graphs.CENTRALITIES)), 9)


@query("g13_g15_centrality_ranks")
def centrality_ranks(spark, sf_dir):
    return graphs.centrality_ranks(strong(spark, sf_dir), GROUP, ["page_rank", "k_core", "strength_edge", "betweenness_edge"], TOP_EDGES)


@query("r04_r05_pruned_centrality")
def pruned_centrality(spark, sf_dir):
    """Centralities of the full daily graph cut to its nodes of highest degree."""
    return graphs.centrality_ranks(graphs.pruned(pairs(spark, sf_dir), GROUP, TOP_NODES), GROUP, ["degree", "page_rank", "hits_hub", "eigenvector", "betweenness"], TOP_EDGES)


@query("r04_global_centrality", f"""WITH {USER_EDGES}, p AS (SELECT from_addr AS a, to_addr AS b, CAST(sum(tx_count) AS DOUBLE) AS w FROM canon WHERE from_addr <> to_addr AND date BETWEEN '{START}' AND '{END}' GROUP BY 1, 2),
e0 AS (SELECT a AS x FROM p UNION ALL SELECT b FROM p), best AS (SELECT x, row_number() OVER (ORDER BY count(*) DESC, x) AS r FROM e0 GROUP BY 1),
k AS (SELECT p.* FROM p JOIN best f ON f.x = a AND f.r <= 500 JOIN best g ON g.x = b AND g.r <= 500), e AS (SELECT a AS x, w FROM k UNION ALL SELECT b, w FROM k),
s AS (SELECT x, CAST(count(*) AS DOUBLE) AS degree, sum(w) AS strength FROM e GROUP BY 1), l AS (SELECT x, unnest(['degree', 'strength']) AS metric, unnest([degree, strength]) AS score FROM s),
r AS (SELECT metric, x, row_number() OVER (PARTITION BY metric ORDER BY round(score, 12) DESC, x) AS r FROM l)
SELECT DATE '{START}' AS start_date, DATE '{END}' AS end_date, metric, x AS address, CAST(r AS INTEGER) AS top_rank, CAST(r AS INTEGER) AS bottom_rank FROM r WHERE r <= 2000""")
def global_centrality(spark, sf_dir):
    """One graph of a whole period, cut to its nodes of highest degree."""
    return graphs.global_centrality(canonical(spark, sf_dir), "tx_count", ["degree", "strength"], TOP_EDGES, TOP_NODES, START, END)


@query("c10_limited_curvature")
def limited_curvature(spark, sf_dir):
    """Each day with a time limit of its own and a status."""
    return rounded(curvature.daily_curvature(pairs(spark, sf_dir), GROUP, seconds=120.0))


@query("r06_efficient_centrality")
def efficient(spark, sf_dir):
    return graphs.efficient_centrality(canonical(spark, sf_dir), GROUP, ["tx_count", "tx_value"], ["page_rank", "strength", "k_core", "clustering"], TOP_EDGES)


COMPONENTS = f"""WITH RECURSIVE {PAIRS}, walk AS (SELECT DISTINCT date, x, x AS y FROM ends UNION SELECT w.date, w.x, e.y FROM walk w JOIN ends e ON e.date = w.date AND e.x = w.y), c AS (SELECT date, x, min(y) AS c FROM walk GROUP BY 1, 2), s AS (SELECT date, c, count(*) AS s FROM c GROUP BY 1, 2)
SELECT date, count(*) AS n_components, max(s) AS largest, round(max(s) / sum(s), 6) AS largest_frac FROM s GROUP BY 1"""


@query("c03_components", COMPONENTS)
def components(spark, sf_dir):
    c = curvature.communities(pairs(spark, sf_dir), GROUP, max_nodes=1 << 30, least=1 << 30)
    return rounded(c.select("date", F.col("n_components").cast("bigint").alias("n_components"), F.col("largest_component").cast("bigint").alias("largest"), F.col("largest_component_frac").alias("largest_frac")))


@query("c03_components_by_joins", COMPONENTS)
def components_by_joins(spark, sf_dir):
    return rounded(graphs.component_sizes(graphs.connected_components(pairs(spark, sf_dir), GROUP), GROUP))


def daily_topology(spark, sf_dir):
    return topology.daily_diagrams(pairs(spark, sf_dir), GROUP)


@query("t02_t07_diagrams")
def diagrams(spark, sf_dir):
    d = daily_topology(spark, sf_dir)
    return rounded(d.select("date", "n_nodes", "n_edges", F.explode("dgm").alias("p")).select("date", "n_nodes", "n_edges", "p.*"))


@query("t09_persistence_features")
def persistence_features(spark, sf_dir):
    return rounded(topology.persistence_features(daily_topology(spark, sf_dir)).drop("dgm"))


@query("t12_t14_features")
def features(spark, sf_dir):
    d = daily_topology(spark, sf_dir).withColumn("run", F.lit("all"))
    return rounded(runs.features(d).drop("dgm"))


@query("t10_t11_distance_series")
def distances(spark, sf_dir):
    """Distances between days, by both metrics, and between the days of two layers stacked; each diagram is made once."""
    d = graphs.checkpointed(daily_topology(spark, sf_dir).withColumn("run", F.lit("all")))
    layers, _ = runs.diagrams(canonical(spark, sf_dir), TOPOLOGY_RUNS, daily_ranks(spark, sf_dir))
    both = topology.stacked(layers.select(F.lit("all").alias("run"), "date", "dgm"), ["run", "date"])
    w, b = topology.distance_series(d, ["run"]), topology.distance_series(d, ["run"], "bottleneck").select("run", "date", F.col("value").alias("bottleneck"))
    twice = topology.distance_series(both, ["run"]).select("run", "date", F.col("value").alias("stacked"))
    return rounded(w.join(b, ["run", "date"]).join(twice, ["run", "date"]))


@query("j09_x13_boundaries")
def boundaries(spark, sf_dir):
    """Monthly graphs of shipments: distances within each year, and across the turn of the year."""
    t = ship_transactions(spark, sf_dir).where("value = 0").select(F.trunc("date", "month").alias("date"), F.col("from_address").alias("from_addr"), F.col("to_address").alias("to_addr"), "gas_used")
    d = topology.daily_diagrams(graphs.strongest(graphs.undirected(t, GROUP, "gas_used"), GROUP, TOP_EDGES), GROUP).withColumn("series_id", F.lit("ship"))
    yearly = topology.distance_series(d.withColumn("y", F.year("date")), ["series_id", "y"]).select("series_id", "date", "value")
    turns = topology.boundary_distances(S.year_boundaries(d, "dgm"))
    return rounded(S.stitched(yearly.unionByName(turns.select("series_id", "date", "value"))))


@query("t07_point_clouds")
def point_clouds(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("key"), "embedding")
    return rounded(topology.daily_features(topology.point_cloud_diagrams(v, "label", "embedding")).drop("dgm"))


def ranked_pairs(spark, sf_dir):
    """Pairs of the first run: its layer, between the nodes that its daily ranking chooses, as the flow of lengths is meant to be used."""
    rows = runs.selected(canonical(spark, sf_dir), TOPOLOGY_RUNS[0], daily_ranks(spark, sf_dir))
    return graphs.undirected(rows, GROUP, "tx_count", repair=True)


@query("c01_curvature")
def curvatures(spark, sf_dir):
    return rounded(curvature.daily_curvature(pairs(spark, sf_dir), GROUP))


@query("c02_curvature_bytes")
def curvature_bytes(spark, sf_dir):
    base = pairs(spark, sf_dir)
    size = canonical(spark, sf_dir).groupBy("date", F.col("from_addr").alias("a"), F.col("to_addr").alias("b")).agg(F.avg("total_input_bytes").alias("bytes"))
    joined = curvature.edge_curvatures(base, GROUP).join(size, ["date", "a", "b"])
    return rounded(audit.right_closed_bins(joined, "bytes", "curvature", 25))


@query("c04_c07_communities")
def communities(spark, sf_dir):
    return rounded(curvature.communities(ranked_pairs(spark, sf_dir), GROUP))


@query("c08_curvature_persistence")
def curvature_persistence(spark, sf_dir):
    return rounded(topology.persistence_features(curvature.curvature_persistence(pairs(spark, sf_dir), GROUP)).drop("dgm"))


@query("c09_community_bands")
def community_bands(spark, sf_dir):
    base = ranked_pairs(spark, sf_dir)
    members = curvature.communities(base, GROUP, members=True)
    size = canonical(spark, sf_dir).groupBy("date", F.col("from_addr").alias("a"), F.col("to_addr").alias("b")).agg(F.avg("total_input_bytes").alias("bytes"))
    means = curvature.incident_means(base.join(size, ["date", "a", "b"]), GROUP, "bytes")
    from tidegraph.functions.layers import byte_band

    rows = members.join(means, ["date", "address"]).withColumn("band", byte_band(F.col("mean_bytes")))
    return rounded(audit.cramers_v(rows, "community", "band", GROUP))


@query("r01_runs")
def all_runs(spark, sf_dir):
    found, counts = runs.diagrams(canonical(spark, sf_dir), TOPOLOGY_RUNS, daily_ranks(spark, sf_dir))
    return rounded(runs.features(found).drop("dgm").join(counts.withColumnRenamed("n_nodes", "n_addresses").withColumnRenamed("n_edges", "n_rows"), ["run", "date"]))


@query("s21_s22_documents")
def run_documents(spark, sf_dir):
    return runs.documents(canonical(spark, sf_dir), TOPOLOGY_RUNS, daily_ranks(spark, sf_dir))


@query("s12_s15_read_back")
def read_back(spark, sf_dir):
    """A run's documents parsed again: its series, stitched, with a day-over-day change."""
    docs = run_documents(spark, sf_dir)
    parsed = docs.select("run", F.from_json("document", documents.RUN).alias("d")).select("run", "d.*")
    s = documents.series_of(parsed)
    d = documents.diagrams_of(parsed).select(F.col("run").alias("series_id"), "date", F.size("dgm").alias("n_points"))
    return rounded(S.stitched(s).join(d, ["series_id", "date"]))


_in = f"filter = '{LAYER}' AND ranking_metric = 'tx_count' AND top_rank <= 40"


@query("r10_sweep", f"""WITH {RANKED}, n AS (SELECT DISTINCT date, address FROM ranks WHERE {_in}),
k AS (SELECT c.* FROM canon c WHERE tx_value > 0 AND EXISTS (SELECT 1 FROM n WHERE n.date = c.date AND n.address = from_addr) AND EXISTS (SELECT 1 FROM n WHERE n.date = c.date AND n.address = to_addr))
SELECT '{LAYER}_top40' AS run, date, count(*) AS n_rows FROM k GROUP BY 2""")
def sweep(spark, sf_dir):
    (run,) = runs.sweep([LAYER], [40], rank_col="top_rank")
    rows = runs.selected(canonical(spark, sf_dir), run, daily_ranks(spark, sf_dir))
    return rows.groupBy("run", "date").agg(F.count("*").alias("n_rows"))


@query("r11_trailing_topology")
def trailing_topology(spark, sf_dir):
    edges = ranking.trailing_edges(canonical(spark, sf_dir), 750).where(condition("simple_txs_ALL"))
    d = topology.daily_diagrams(graphs.undirected(edges, GROUP, "tx_count", repair=True), GROUP).withColumn("run", F.lit("trailing"))
    return rounded(runs.features(d).drop("dgm"))
