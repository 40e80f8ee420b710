"""Connected components of an edge table, on Spark tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import written


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from each end of an edge.

    Every round takes the smallest label among a node's neighbours, then the
    label's own label (pointer jumping), so long chains need few rounds.  The
    labels are written after each round; minima are combined before shuffling,
    and joins at a hub are split by Spark's skew handling.  Self-edges only
    name a node.  Runs jobs when called.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
                   .distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(
        F.least(F.min("v"), F.first("u")).alias("component")), "cc-labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "v"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near")))
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("component").alias("top"))
        new = written(step.join(up, "mid").select(
            "node", "old", F.least("mid", "top").alias("component")), "cc-labels")
        labels = new.select("node", "component")
        if new.where(F.col("old") != F.col("component")).limit(1).count() == 0:
            return labels
