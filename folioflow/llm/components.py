"""Connected components of a graph given as a table of links, for classes of near copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest reachable node) for every node of a link; loops and repeated links do no harm.

    Each round every node takes the smallest label of itself and its neighbours, then the label of its label, so labels
    travel twice as far each round. Messages are combined before they are shuffled, and a hot node's row is small, so no
    task holds a component. Every round is written to the shared folder, which cuts the lineage.
    """
    both = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    edges = stored(both.union(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = stored(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("component")))
    while True:
        told = edges.join(labels.select(F.col("node").alias("src"), "component"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("told"))
        near = labels.join(told, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("told", "component")).alias("component"))
        heads = labels.select(F.col("node").alias("component"), F.col("component").alias("head"))
        jumped = near.join(heads, "component", "left").select("node", "was", F.least("component", F.coalesce("head", "component")).alias("component"))
        new = stored(jumped)
        done = new.where("component <> was").isEmpty()
        drop_stored(labels)
        labels = new.select("node", "component")
        if done:
            drop_stored(edges)
            return labels
