"""Writing and reading of what the pipeline makes: chunk table, graph JSON, embeddings and a page that shows a graph."""

from __future__ import annotations

import html
import json

from pyspark.ml.feature import Word2VecModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators.vectors import embed


def create_chunk_table(chunks: DataFrame, path: str) -> None:
    """Writes ``uid, url, text`` with derived vectors in place of what is there."""
    chunks.withColumn("vector", embed(F.col("text"))).write.mode("overwrite").parquet(path)


def append_chunks(chunks: DataFrame, path: str) -> None:
    chunks.withColumn("vector", embed(F.col("text"))).write.mode("append").parquet(path)


def open_chunk_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_embeddings(model: Word2VecModel, path: str) -> None:
    """Embeddings of keys, in place of what is there; one row a key as Parquet, so the vocabulary may have any size."""
    model.getVectors().select("word", F.col("vector").alias("v")).transform(_as_array).write.mode("overwrite").parquet(path)


def _as_array(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return df.select(F.col("word").alias("key"), vector_to_array("v").alias("vector"))


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """``key, vector array<double>`` as saved, for ``vectors.entity_neighbours``."""
    return spark.read.parquet(path)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, json``: one line of JSON for each node and edge, keys in order, nulls left out; for graphs of any size."""
    line = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*sorted(df.columns))).alias("json"))
    return line(nodes, "node").unionByName(line(edges, "link"))


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str, most: int = 1_000_000) -> None:
    """One JSON object of nodes and links in a local file, for graphs small enough to read whole; larger ones are refused."""
    if nodes.count() + edges.count() > most:
        raise ValueError("the graph is too large for one object; write graph_json instead")
    rows = lambda df: [{k: v for k, v in json.loads(s).items()} for s in (r[0] for r in df.select(F.to_json(F.struct(*df.columns))).collect())]
    whole = {"directed": False, "graph": {}, "links": [{("source" if k == "src" else "target" if k == "dst" else k): v for k, v in e.items()} for e in rows(edges)], "multigraph": False, "nodes": rows(nodes)}
    with open(path, "w", encoding="utf-8") as out:
        json.dump(whole, out, indent=2, sort_keys=True)


def write_html(viz: DataFrame, edges: DataFrame, path: str, most: int = 5000) -> None:
    """A page that lists what a picture of the graph shows, written once, with or without edges.

    Graphs with over ``most`` nodes or edges are refused.
    """
    nodes, links = viz.limit(most + 1).collect(), edges.limit(most + 1).collect()
    if max(len(nodes), len(links)) > most:
        raise ValueError("the graph is too large for one page; write graph_json instead")
    body = "".join(f"<tr><td>{html.escape(str(n['id']))}<td>{n['size']}<td>{html.escape(n['label'] or '')}<td>{html.escape(n['title'] or '')}" for n in nodes)
    lines = "".join(f"<li>{html.escape(str(e['src']))} – {html.escape(e['rel'])} – {html.escape(str(e['dst']))}" for e in links)
    with open(path, "w", encoding="utf-8") as out:
        out.write(f"<!doctype html><meta charset=utf-8><title>graph</title><table>{body}</table><ul>{lines}</ul>")
