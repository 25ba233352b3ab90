"""The semantic overlay: entities of all documents merged, linked to their chunks and to each other; and views of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.operators.graph import COMPOUND, FOLLOWS


def entity_nodes(ns: DataFrame) -> DataFrame:
    """``node_id, key, text, label, count``: first document's text and label, counts added up."""
    return ns.filter("kind = 'Entity'").groupBy("node_id").agg(F.min_by(F.struct("key", "text", "label"), "doc_seq").alias("e"), F.sum("count").alias("count")).select("node_id", "e.key", "e.text", "e.label", "count")


def overlay_nodes(ns: DataFrame, chunks: DataFrame) -> DataFrame:
    """``id, kind, key, text, label, count, chunk_uid, url``: all chunks, and the entities."""
    null = lambda t: F.lit(None).cast(t)
    ents = entity_nodes(ns).select(F.col("node_id").cast("string").alias("id"), F.lit("Entity").alias("kind"), "key", "text", "label", F.col("count").cast("long").alias("count"), null("long").alias("chunk_uid"), null("string").alias("url"))
    return ents.unionByName(
        chunks.select(F.concat(F.lit("chunk_"), F.col("chunk_uid").cast("string")).alias("id"), F.lit("Chunk").alias("kind"), null("string").alias("key"), null("string").alias("text"), null("string").alias("label"), null("long").alias("count"), "chunk_uid", "url")
    )


def within_edges(ranked: DataFrame) -> DataFrame:
    """``src, dst, rel, weight``: each entity of a document to the chunk of its last mention."""
    return ranked.select(F.col("node_id").cast("string").alias("src"), F.concat(F.lit("chunk_"), F.col("chunk_uid").cast("string")).alias("dst"), F.lit("WITHIN").alias("rel"), F.round("rank", 9).alias("weight"))


def overlay_edges(ns: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst, rel, prob``: edges between entities other than lexical ones; the first document's relation, the greatest probability."""
    ents = ns.filter("kind = 'Entity'").select("doc_seq", "node_id")
    kept = edges.filter(~F.col("rel").isin(FOLLOWS, COMPOUND)).join(ents.withColumnRenamed("node_id", "src"), ["doc_seq", "src"], "left_semi").join(ents.withColumnRenamed("node_id", "dst"), ["doc_seq", "dst"], "left_semi")
    return kept.groupBy("src", "dst").agg(F.min_by("rel", "doc_seq").alias("rel"), F.max(F.coalesce("prob", F.lit(1.0))).alias("prob"))


def promotion_report(ns: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each document how many nodes and edges are kept for the overlay, and of how many."""
    n = ns.groupBy("doc_seq").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("kind") == "Entity").alias("n_kept_nodes"))
    ents = ns.filter("kind = 'Entity'").select("doc_seq", "node_id", F.lit(1).alias("is"))
    e = edges.join(ents.select("doc_seq", F.col("node_id").alias("src"), F.col("is").alias("s")), ["doc_seq", "src"], "left").join(ents.select("doc_seq", F.col("node_id").alias("dst"), F.col("is").alias("d")), ["doc_seq", "dst"], "left")
    e = e.groupBy("doc_seq").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("s").isNotNull() & F.col("d").isNotNull() & ~F.col("rel").isin(FOLLOWS, COMPOUND)).alias("n_kept_edges"))
    return n.join(e, "doc_seq", "left").fillna(0, ["n_edges", "n_kept_edges"])


def pronoun_keys(words: DataFrame) -> DataFrame:
    """Keys of the dictionary with a pronoun in them."""
    return words.filter(F.contains(F.col("key"), F.lit("PRON"))).select("key", "node_id")


def viz_overlay(onodes: DataFrame, n_docs: int) -> DataFrame:
    """What a picture of the overlay shows of each node: size, label, title, colour."""
    entity = F.col("kind") == "Entity"
    size = F.when(entity, F.bround(20 * F.log(1 + F.sqrt(F.col("count")) / n_docs))).otherwise(5).cast("int")
    return onodes.select("id", size.alias("size"), F.when(entity, F.col("text")).otherwise(F.col("id")).alias("label"), F.when(entity, F.col("key")).otherwise(F.col("url")).alias("title"), F.when(entity, "entity").otherwise("chunk").alias("colour"))


def viz_lexical(striped: DataFrame) -> DataFrame:
    """What a picture of a lexical graph shows of each node."""
    size = F.bround(F.when(F.col("kind") == "Entity", 200).otherwise(30) * F.round("rank", 9)).cast("int")
    return striped.select("doc_seq", "node_id", size.alias("size"), F.col("text").alias("label"), F.col("key").alias("title"))
