"""PageRank of each document's graph, quantile stripes and the combined rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA, ROUNDS = 0.85, 20


def _pagerank(rows: pa.Table) -> pa.Table:
    """One document's graph: rows without ``dst`` are its nodes, the others its edges."""
    alone = rows["dst"].is_null().to_numpy()
    src, dst, count = (rows[c].fill_null(0).to_numpy() for c in ("src", "dst", "count"))
    order = np.argsort(src[alone])
    ids, count = src[alone][order], count[alone][order]
    n = len(ids)
    a, b = np.searchsorted(ids, src[~alone]), np.searchsorted(ids, dst[~alone])
    twice = a != b
    src, dst = np.concatenate([a, b[twice]]), np.concatenate([b, a[twice]])
    degree = np.bincount(src, minlength=n)
    idle = degree == 0
    share = 1.0 / np.maximum(degree, 1)
    r = np.full(n, 1.0 / n)
    for _ in range(ROUNDS):
        r = (1 - ALPHA) / n + ALPHA * (np.bincount(dst, weights=(r * share)[src], minlength=n) + r[idle].sum() / n)
    return pa.table({"doc_seq": pa.array(np.full(n, rows["doc_seq"][0].as_py())), "node_id": pa.array(ids), "count": pa.array(count), "pagerank": pa.array(r)})


def pagerank(ns: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_seq, node_id, count, pagerank`` after 20 rounds, unweighted; an edge serves both ways, a self-loop once.

    A document's graph is the size of its page and is ranked in one task; documents are ranked in parallel. Nodes
    without edges spread their rank over all. A document without nodes gives no rows. ``count`` is that of ``ns``.
    """
    count = F.col("count").cast("long") if "count" in ns.columns else F.lit(None).cast("long")
    both = ns.select("doc_seq", F.col("node_id").alias("src"), F.lit(None).cast("long").alias("dst"), count.alias("count")).unionByName(edges.select("doc_seq", "src", "dst", F.lit(None).cast("long").alias("count")))
    return both.groupBy("doc_seq").applyInArrow(_pagerank, "doc_seq long, node_id long, count long, pagerank double")


def bins(n: Column) -> Column:
    """Evenly spaced points of 0 to 1, about four times the logarithm of ``n`` of them, one at least."""
    g = F.greatest(F.bround(F.log(n) * 4), F.lit(1)).cast("int")
    return F.when(g == 1, F.array(F.lit(0.0))).otherwise(F.transform(F.sequence(F.lit(0), g - 1), lambda i: i / (g - 1)))


def quantiles(ordered: Column, points: Column) -> Column:
    """Of ordered values the nearest to each point of 0 to 1."""
    return F.transform(points, lambda p: F.get(ordered, F.bround(p * (F.size(ordered) - 1)).cast("int")))


def stripe(value: Column, of: Column) -> Column:
    """The number of the last quantile that isn't above ``value``."""
    return F.size(F.filter(of, lambda q: q <= value)) - 1


def rank_stripes(ns: DataFrame, ranks: DataFrame) -> DataFrame:
    """``doc_seq, node_id, kind, key, text, label, chunk_uid, count, pagerank, stripe_weight, stripe_count, rank``.

    ``ranks`` are those that ``pagerank`` gives for ``ns``. The rank is the root mean square of both stripes, as a share of the document's sum; where all are 0 it is even. The
    quantiles of a document, about four times the logarithm of its size, are computed once for it.
    """
    w = Window.partitionBy("doc_seq")
    f = ranks.withColumn("pagerank", F.round("pagerank", 12)).repartition("doc_seq")
    f = f.withColumn("x", F.round(F.col("pagerank") / F.max("pagerank").over(w), 9)).withColumn("y", F.col("count") / F.max("count").over(w))
    whole = f.groupBy("doc_seq").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.array_sort(F.collect_list("y")).alias("ys"), F.count(F.lit(1)).alias("n")).withColumn("points", bins(F.col("n")))
    points = whole.select("doc_seq", "n", quantiles(F.col("xs"), F.col("points")).alias("qx"), quantiles(F.col("ys"), F.col("points")).alias("qy"))
    f = f.join(points, "doc_seq").withColumn("stripe_weight", stripe(F.col("x"), F.col("qx"))).withColumn("stripe_count", stripe(F.col("y"), F.col("qy")))
    f = f.withColumn("r", F.sqrt((F.col("stripe_weight") * F.col("stripe_weight") + F.col("stripe_count") * F.col("stripe_count")) / 2))
    total = F.sum("r").over(w)
    ranked = f.withColumn("rank", F.when(total > 0, F.col("r") / total).otherwise(1.0 / F.col("n"))).select("doc_seq", "node_id", "pagerank", "stripe_weight", "stripe_count", "rank")
    return ns.select("doc_seq", "node_id", "kind", "key", "text", "label", "chunk_uid", "count").join(ranked, ["doc_seq", "node_id"])


def textrank(striped: DataFrame) -> DataFrame:
    """Entities alone, with their rank among all nodes."""
    return striped.filter("kind = 'Entity'")


def top_entities(ranked: DataFrame, k: int = 20) -> DataFrame:
    """Of each document the ``k`` entities of greatest rank, ties by id."""
    return ranked.selectExpr("*", "row_number() over (partition by doc_seq order by round(rank, 12) desc, node_id) as place").filter(F.col("place") <= k)
