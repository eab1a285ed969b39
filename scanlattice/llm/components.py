"""Connected components by label propagation with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v), undirected -> one row per node: node, component (the smallest node reachable).

    Each round takes the smallest label among neighbours, then follows labels once, so the rounds
    grow with the logarithm of the diameter. Each round's labels are written to the shared folder."""
    both = written(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("near"))
        stepped = labels.join(near, labels.node == near.u).select("node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("component").alias("jump"))
        after = written(stepped.join(target, "label").select("node", F.least("label", "jump").alias("component"), (F.least("label", "jump") < F.col("old")).alias("moved")), "labels")
        if not after.where("moved").limit(1).count():
            return after.select("node", "component")
        labels = after.select("node", "component")
