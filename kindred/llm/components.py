"""Connected components over a table of edges, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, kept_path, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (u, v long): label is its component's smallest node.

    Each round takes the smallest label among a node and its neighbours, then that label's own
    label, so that chains shorten by pointer jumping. A star is done in two rounds.
    """
    both = written(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("low"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "low").alias("low"))
        far = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        new = written(low.join(far, "low").select("node", F.least("low", "jump").alias("label"), (F.least("low", "jump") < F.col("label")).alias("moved")), "labels")
        drop(labels)
        labels = kept_path(new.select("node", "label"), new)
        if new.where("moved").isEmpty():
            drop(both)
            return labels
