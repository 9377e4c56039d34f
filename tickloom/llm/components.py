"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for each node in ``edges`` (a, b).

    Each round takes the least label among a node's neighbours and then the label of that label, so paths halve as trees are climbed. All steps
    are joins and combining minima on the cluster; rounds are written, so lineage stays short. Nulls and self loops are ignored; repeated
    edges do no harm; no edges give no rows.
    """
    edges = edges.select("a", "b").where("a <> b")
    both = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node", "left").select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("above"))
        new = written(met.join(up, "next", "left").select("node", F.col("label").alias("old"), F.least("next", "above").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels
