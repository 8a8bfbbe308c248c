"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioflow.sources.shared import checkpointed

MOST_ROUNDS = 60  # of label spreading; labels jump, so a chain of n nodes takes about log n rounds


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of the edges with the smallest node it is connected to.

    Each round takes the smallest label among neighbours, then the label's own label; rounds are written to the
    shared folder, and only the count of changed labels comes to the driver. Null ends of edges are left out.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node is not null and other is not null and node <> other")
    both = checkpointed(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = checkpointed(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        better = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        after = checkpointed(better.join(jump, "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component"), "was"))
        changed = after.where("component <> was").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components not found in {MOST_ROUNDS} rounds")
