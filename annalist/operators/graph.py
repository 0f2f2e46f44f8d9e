"""Connected components and cell grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """id, component (the least id) of nodes (id long) joined by edges (a, b): least labels, then jumps to a label's own.

    Each round joins labels to edges and halves the way to the least one, so rounds grow with the logarithm of a
    component's width. Labels are checkpointed, where a checkpoint folder is set, to keep the plan short.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().cache()
    keep = lambda d: d.checkpoint() if d.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else d.cache()
    labels = keep(nodes.select("id", F.col("id").alias("component")).distinct())
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        low = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("was"))
        jump = low.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = keep(low.join(jump, "component", "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component"), "was"))
        moved = new.where("component <> was").limit(1).count()
        labels = new.select("id", "component")
        if not moved:
            return labels
    raise RuntimeError(f"labels still moved after {most_rounds} rounds")
