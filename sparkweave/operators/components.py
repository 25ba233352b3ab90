"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.operators.skew import skew_lookup
from sparkweave.session import materialize


#: Rounds of plain steps before labels are jumped from as well; components of few steps across need no jumps.
PLAIN = 3


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: of each of ``nodes`` the least node it is connected with by ``edges`` (``a, b``).

    Rounds of least-neighbour steps, each followed, after the first few, by a jump to the label's own label, so that long
    chains take few rounds. Each round but the last lowers a label and none rises, so they end by themselves. Labels of a
    round are a written table; the edges of a hub are spread over tasks. Edges with a null end count for nothing, nodes
    without edges are their own component, and an empty table gives none.
    """
    links = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree")).select("node", F.col("node").alias("component"), "degree"), "cc-labels")
    sizes = tuple(labels.agg(F.sum("degree"), F.max("degree")).first())
    rounds, changed = 0, sizes[0] is not None
    while changed:
        near = skew_lookup(both, labels.select(F.col("node").alias("b"), "component", "degree"), "b", "degree", F.col("a"), sizes=sizes)
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = materialize(labels.join(least, "node").select("node", "degree", F.col("component").alias("old"), F.least("component", "near").alias("component")), "cc-steps")
        changed = not stepped.filter("old <> component").isEmpty()
        if changed and rounds >= PLAIN:
            # a component's label is jumped from by all its nodes
            fans = stepped.groupBy(F.col("component").alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))
            jump = fans.join(labels.select(F.col("node").alias("label"), F.col("component").alias("further")), "label")
            jumped = skew_lookup(stepped.withColumnRenamed("component", "label"), jump, "label", "n_rows", F.col("node"))
            stepped = materialize(jumped.select("node", "degree", F.least("label", "further").alias("component")), "cc-labels")
        labels, rounds = stepped.select("node", "component", "degree"), rounds + 1
    return nodes.select("node").distinct().join(labels.select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
