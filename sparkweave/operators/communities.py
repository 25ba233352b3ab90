"""Communities of a graph by label propagation, in place of a method without a fixed result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.session import materialize


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``node, community`` after some rounds in which each node takes its neighbours' most frequent label, ties to the least.

    Each node counts its own label as well, which keeps pairs from swapping. Labels of a round are a written table.
    """
    links = edges.select("src", "dst").filter("src <> dst")
    both = materialize(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "lpa-edges")
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("dst"), "community"), "dst").select(F.col("src").alias("node"), "community").unionByName(labels.select("node", "community"))
        counted = votes.groupBy("node", "community").agg(F.count(F.lit(1)).alias("n"))
        labels = materialize(counted.groupBy("node").agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community")), "lpa-labels")
    return labels
