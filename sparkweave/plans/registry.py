"""The queries of the reference's operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions import html, text
from sparkweave.operators import annotate, chunking, communities, graph, overlay, rank, vectors
from sparkweave.plans import kg
from sparkweave.plans.oracles import ORACLE
from sparkweave.session import materialize
from sparkweave.sources import sinks
from sparkweave.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "text").filter("text is not null")


def scrub_text(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", text.scrub(F.col("text")).alias("text"))


def as_page(body: Column) -> Column:
    """A document's lines as paragraphs of a page, with a script, a comment and character references."""
    safe = F.replace(F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    inner = F.replace(safe, F.lit("\n"), F.lit('</p>\n<p class="x">'))
    return F.concat(F.lit('<html><head><script>var a = "<p>no</p>";</script></head><body><!-- <p>no</p> --><h1>no</h1><div><p>'), inner, F.lit("</div><div>no</div></body></html>"))


def html_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", html.paragraphs(as_page(F.col("text"))).alias("paragraphs"))


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("sent_id", "sentence"))


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(_docs(spark, sf))


def chunk_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.number_chunks(chunk_documents(spark, sf)).select("doc_id", "pos", "uid", "node")


def token_annotations(spark: SparkSession, sf: str) -> DataFrame:
    return kg.load_corpus(spark, sf).tokens.select("chunk_uid", "sent_id", "tok_i", "text", "pos", "lemma", "key")


_SPAN = ["chunk_uid", "sent_id", "span_start", "span_end", "key", "text", "label"]


def noun_chunk_spans(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.noun_chunks(kg.load_corpus(spark, sf).tokens).select(*_SPAN)


def gazetteer_ner(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.named_entities(kg.load_corpus(spark, sf).tokens, annotate.gazetteer(read_table(spark, sf, "entities"))).select(*_SPAN)


def relation_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.relation_candidates(kg.load_corpus(spark, sf).entities)


def entity_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return kg.load_corpus(spark, sf).entities.select("chunk_uid", "span_start", "span_end", "sent_id", "key", "text", "label", "promoted")


def lemma_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return kg.lexical_graph(kg.load_corpus(spark, sf), with_edges=False).dictionary.select("key", "node_id")


def lemma_nodes(spark: SparkSession, sf: str) -> DataFrame:
    toks = kg.load_corpus(spark, sf).tokens.filter(F.col("pos").isin("NOUN", "PROPN"))
    at = F.struct("chunk_uid", "tok_i")
    return toks.groupBy("doc_seq", "key").agg(F.count(F.lit(1)).alias("count"), F.min_by("text", at).alias("text"), F.min_by("pos", at).alias("pos"))


def entity_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return kg.lexical_graph(kg.load_corpus(spark, sf), with_edges=False).nodes.drop("created")


def lookback_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.lookback_edges(kg.load_corpus(spark, sf).tokens)


def compound_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.compound_edges(materialize(kg.lexical_graph(kg.load_corpus(spark, sf), with_edges=False).nodes, "kg-nodes"))


def cooccurrence_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cooccurrence_edges(kg.with_missing_ends(kg.load_corpus(spark, sf)))


def relation_edges(spark: SparkSession, sf: str) -> DataFrame:
    corpus = kg.load_corpus(spark, sf)
    return graph.relation_edges(corpus.relations, kg.with_missing_ends(corpus))


def relation_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that ends of relations bring in; the delivered relations' ends that are no entity are those without key.

    Relations between noun chunks, shifted by a word, are added so that there are ends to be made.
    """
    corpus = kg.load_corpus(spark, sf)
    return kg.missing_entities(replace(corpus, relations=_shifted(corpus.relations))).select("chunk_uid", "sent_id", "span_start", "span_end", "key", "text", "label", "promoted", "made")


def _shifted(rels: DataFrame) -> DataFrame:
    """Relations, and each once more from the word before its head to its tail."""
    return rels.unionByName(rels.withColumn("h_start", F.col("h_start") - 1).filter("h_start >= 0"))


def pairwise_relations(spark: SparkSession, sf: str) -> DataFrame:
    corpus = kg.load_corpus(spark, sf)
    return annotate.pairwise_relations(annotate.noun_chunks(corpus.tokens), annotate.gazetteer(read_table(spark, sf, "entities")))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select(F.col("doc_id").alias("page_id"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), as_page(F.col("text")).alias("html"))


def page_corpus(spark: SparkSession, sf: str) -> kg.Corpus:
    """A corpus made of pages by the default annotator: the documents' texts as pages, names from the delivered mentions."""
    return kg.corpus_from_pages(_pages(spark, sf), annotate.RuleAnnotator(materialize(annotate.gazetteer(read_table(spark, sf, "entities")), "kg-names")))


def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return kg.chunk_pages(_pages(spark, sf))


def page_entities(spark: SparkSession, sf: str) -> DataFrame:
    return page_corpus(spark, sf).entities.select("chunk_uid", "span_start", "span_end", "sent_id", "key", "text", "label", "promoted")


def kg_from_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of the graph that is built from pages."""
    g = kg.lexical_graph(page_corpus(spark, sf), with_edges=False)
    return overlay.overlay_nodes(g.nodes, g.corpus.chunks)


def resolved_edges(spark: SparkSession, sf: str) -> DataFrame:
    return kg.lexical_graph(kg.load_corpus(spark, sf)).edges


def _graph(spark: SparkSession, sf: str) -> tuple[kg.Graph, DataFrame]:
    g = kg.lexical_graph(kg.load_corpus(spark, sf))
    return g, materialize(g.edges, "kg-edges")


def pagerank_fixed20(spark: SparkSession, sf: str) -> DataFrame:
    g, edges = _graph(spark, sf)
    return rank.pagerank(g.nodes, edges).select("doc_seq", "node_id", F.round("pagerank", 9).alias("pagerank"))


def _striped(spark: SparkSession, sf: str) -> DataFrame:
    g, edges = _graph(spark, sf)
    return rank.rank_stripes(g.nodes, rank.pagerank(g.nodes, edges))


def rank_stripes(spark: SparkSession, sf: str) -> DataFrame:
    return _striped(spark, sf).select("doc_seq", "node_id", "stripe_weight", "stripe_count", F.round("rank", 9).alias("rank"))


def textrank(spark: SparkSession, sf: str) -> DataFrame:
    return rank.textrank(_striped(spark, sf)).select("doc_seq", "node_id", "key", "text", "label", "count", F.round("rank", 9).alias("rank"))


def top_entities(spark: SparkSession, sf: str) -> DataFrame:
    return rank.top_entities(rank.textrank(_striped(spark, sf))).select("doc_seq", "node_id", "key", F.round("rank", 9).alias("rank"))


def overlay_nodes(spark: SparkSession, sf: str) -> DataFrame:
    g = kg.lexical_graph(kg.load_corpus(spark, sf), with_edges=False)
    return overlay.overlay_nodes(g.nodes, g.corpus.chunks)


def overlay_edges(spark: SparkSession, sf: str) -> DataFrame:
    g, edges = _graph(spark, sf)
    return overlay.overlay_edges(g.nodes, edges)


def within_edges(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.within_edges(rank.textrank(_striped(spark, sf)))


def pronoun_qc(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.pronoun_keys(lemma_dictionary(spark, sf))


def promotion_report(spark: SparkSession, sf: str) -> DataFrame:
    g, edges = _graph(spark, sf)
    return overlay.promotion_report(g.nodes, edges)


def sentence_bags(spark: SparkSession, sf: str) -> DataFrame:
    return graph.sentence_bags(kg.with_missing_ends(kg.load_corpus(spark, sf)))


def entity_word2vec(spark: SparkSession, sf: str) -> DataFrame:
    model = vectors.train_entities(sentence_bags(spark, sf))
    return model.getVectors() if model else spark.createDataFrame([], "word string, vector array<double>")


def viz_overlay(spark: SparkSession, sf: str) -> DataFrame:
    g = kg.lexical_graph(kg.load_corpus(spark, sf), with_edges=False)
    n = g.corpus.chunks.select(F.countDistinct("doc_seq")).first()[0]
    return overlay.viz_overlay(overlay.overlay_nodes(g.nodes, g.corpus.chunks), max(n, 1))


def viz_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.viz_lexical(_striped(spark, sf))


def kg_json(spark: SparkSession, sf: str) -> DataFrame:
    parts = kg.build_kg(kg.load_corpus(spark, sf))
    return sinks.graph_json(parts["kg_nodes"], kg.graph_links(parts))


def communities_lpa(spark: SparkSession, sf: str) -> DataFrame:
    return communities.label_propagation(overlay_edges(spark, sf))


def _query_vector(spark: SparkSession, sf: str) -> tuple[DataFrame, list[float]]:
    """The table and the vector that is looked for: the one of id 0."""
    table = read_table(spark, sf, "embeddings")
    return table, table.filter("vec_id = 0").first()["embedding"]


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.search(*_query_vector(spark, sf))


def vector_neighbours_positive(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.neighbours(*_query_vector(spark, sf))


def mean_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return vector_neighbours_positive(spark, sf).agg(F.round(F.avg("similarity"), 5).alias("mean_similarity"))


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return kg.load_corpus(spark, sf).chunks.select(F.col("chunk_uid").alias("uid"), "url", "text", vectors.embed(F.col("text")).alias("vector"))


def chunk_search(spark: SparkSession, sf: str) -> DataFrame:
    """The reference's sample query over the chunk table."""
    return vectors.search_text(chunk_vectors(spark, sf), "alzheimer")


_ALL: list[Query] = [
    scrub_text, html_paragraphs, sentence_split, chunk_documents, chunk_numbering, token_annotations, noun_chunk_spans, gazetteer_ner, relation_candidates, entity_dedupe, lemma_dictionary,
    lemma_nodes, entity_nodes, lookback_edges, compound_edges, cooccurrence_edges, relation_edges, resolved_edges, pagerank_fixed20, rank_stripes, textrank, top_entities, overlay_nodes,
    overlay_edges, within_edges, pronoun_qc, promotion_report, sentence_bags, entity_word2vec, viz_overlay, viz_lexical, kg_json, communities_lpa, vector_topk, vector_neighbours_positive,
    mean_similarity, chunk_vectors, chunk_search, relation_backfill, pairwise_relations, page_chunks, page_entities, kg_from_pages,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
