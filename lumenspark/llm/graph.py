"""Connected components of an edge table, by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, label): label is the smallest node of the component. Rounds grow with the log of its diameter.

    Nodes, labels and edges stay distributed; each round ends in the shared folder.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    both = cut(e.union(e.select("v", "u")).distinct(), "cc-edges")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")), "cc-labels")
    while True:
        of = labels.select(F.col("node").alias("v"), F.col("label").alias("near"))
        heard = both.join(of, "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        step = cut(labels.join(heard, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("was")), "cc-step")
        top = step.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = cut(step.join(top, "label", "left").select("node", F.least("label", F.coalesce("top", "label")).alias("label"), "was"), "cc-labels")
        if labels.where("label <> was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
