"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b of long): the smallest node of its component.

    Each round takes the least label among a node and its neighbours and then follows the
    label's own label, until nothing changes; the rounds grow with the logarithm of the
    longest path.  Every step is a join of written tables followed by a partial minimum,
    so a node with very many links is split by the skew handling of the join.  Links from a
    node to itself keep it as a component; links may repeat; null ends are left out.
    """
    links = links.where("a is not null and b is not null").select("a", "b")
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    own = links.select("a", F.col("a").alias("b")).union(links.select(F.col("b").alias("a"), "b"))
    links = materialise(links.union(back).union(own).distinct(), "links")
    labels = materialise(links.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = links.join(labels, links.b == labels.node).groupBy("a").agg(
            F.min("label").alias("label"),
            F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old"))
        near = materialise(near, "near")
        jump = near.select(F.col("a").alias("node"), F.col("label").alias("next"))
        far = near.join(jump, near.label == jump.node).select(
            F.col("a").alias("node"), F.least("label", "next").alias("label"), "old")
        far = materialise(far, "labels")
        if far.where("label < old").isEmpty():
            return far.select("node", "label")
        labels = far.select("node", "label")
