"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b): the smallest node that can be reached. Nodes without a link are not in it.

    Each round takes the smallest label around a node and then that label's own label, so labels travel
    twice as far each time. Rounds are written to the shared folder, which cuts their lineage. A node with very
    many links is summed up before the shuffle, and joins with it are split by the engine."""
    both = links.select("a", "b").where("a <> b").union(links.select("b", "a").where("a <> b")).distinct()
    both = written(both, "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
    labels = written(labels.select("node", F.least("node", "b").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        root = labels.select(F.col("node").alias("low"), F.col("component").alias("root"))
        step = step.join(root, "low", "left").select("node", F.least("low", "root").alias("new"), (F.least("low", "root") != F.col("component")).alias("moved"))
        step = written(step, "labels")
        labels = step.select("node", F.col("new").alias("component"))
        if not step.where("moved").limit(1).count():
            return labels
