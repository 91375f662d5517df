"""Connected components of an edge table, distributed: least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node long, label long), the least node each can reach; nodes without edges are absent.

    Every round reduces with a map-side minimum and is written to the shared folder, so a lost executor costs one
    round. Where labels are joined to a hub's edges, Spark's skew join splits them.
    """
    both = save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        least = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        after = (
            labels.join(hop, "label", "left")
            .join(least, "node")
            .select("node", F.least("label", "m", "jump").alias("label"), (F.least("label", "m", "jump") < F.col("label")).alias("moved"))
        )
        after = save(after, "labels")
        discard(labels)
        labels = after.select("node", "label")
        if not after.filter("moved").limit(1).count():
            discard(both)
            return labels
