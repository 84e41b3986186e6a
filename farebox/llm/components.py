"""Connected components of a graph given by its links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.staging import stage


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node it can reach) for both ends of ``a``, ``b``.

    In every round a node takes the smallest label of its neighbours, then the label of its
    label, which about doubles the distance covered. Every round is a written table, so the
    plan stays short and a lost executor costs one round.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")), "links")
    labels = stage(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        near = (
            both.join(labels, both["a"] == labels["node"])
            .groupBy("b").agg(F.min("label").alias("near"))
        )
        nearer = labels.join(near, labels["node"] == near["b"], "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        nearer = stage(nearer, "labels-near")
        beyond = nearer.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        moved = stage(
            nearer.join(beyond, F.col("label") == F.col("via")).select(
                "node", "old", F.least("label", "beyond").alias("label")
            ),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels
