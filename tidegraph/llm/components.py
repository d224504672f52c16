"""Connected components of an edge table by alternating label spread and pointer jumping.

Each round every node takes the smallest label among its neighbours' labels and
then its label's label, so the number of rounds grows with the logarithm of a
component's diameter on the graphs met here. Labels only fall, so the rounds end
by themselves: there is no limit to them. Each round is written to the shared
folder, which cuts the lineage, and the round before is deleted; only whether a
row has changed reaches the driver. All aggregations are minima, combined before
they are shuffled, so a node with very many neighbours is no hot spot.

Defined results: edges with a null end, loops and repeated edges say nothing; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node reachable. Nodes without an edge are not listed."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = written(labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")), "labels")
        # all nodes of a component ask for one label: where the labels in use point is found first, so that adaptive execution can split the asking side
        hop = written(spread.select("label").distinct().join(spread.select(F.col("node").alias("label"), F.col("label").alias("hop")), "label"), "hops")
        step = written(spread.join(hop, "label", "left").select("node", "old", F.least("label", F.coalesce("hop", "label")).alias("label")), "labels")
        discard(labels, spread, hop)
        labels = step
        if not step.where("label <> old").limit(1).count():
            discard(both)
            return step.select("node", F.col("label").alias("component"))
