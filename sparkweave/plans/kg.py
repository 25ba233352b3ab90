"""The construction of the knowledge graph, set at a time over all documents."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions.html import page_text
from sparkweave.operators import annotate, chunking, graph, overlay, rank, vectors
from sparkweave.session import materialize
from sparkweave.sources import sinks
from sparkweave.sources.tables import read_table


@dataclass
class Corpus:
    """Annotated chunks: ``chunks (doc_seq, chunk_uid, url, text)``, tokens, entities and relations.

    With an ``annotator`` the tokens of some chunks are made anew, where that costs less than to look them up among all.
    """

    chunks: DataFrame
    tokens: DataFrame
    entities: DataFrame
    relations: DataFrame
    annotator: annotate.Annotator | None = None

    def tokens_of(self, some: DataFrame) -> DataFrame:
        """The tokens of the chunks whose ``chunk_uid`` are in ``some``."""
        if self.annotator is None:
            return self.tokens.join(some, "chunk_uid", "left_semi")
        return self.annotator.tokens(self.chunks.join(some, "chunk_uid", "left_semi"))


def load_corpus(spark: SparkSession, sf: str, annotator: annotate.Annotator | None = None) -> Corpus:
    """Each chunk with text once, with its page's number; tokens by the annotator, entities and relations as delivered.

    A chunk without url, or with one that no page has, takes the number from its mentions; without either it has no document.
    """
    annotator = annotator or annotate.RuleAnnotator()
    pages = read_table(spark, sf, "urls").filter("url is not null").groupBy("url").agg(F.min("doc_seq").cast("long").alias("doc_seq"))
    rows = read_table(spark, sf, "text_chunk").filter("uid is not null and text is not null").select("uid", "url", "text")
    one = rows.groupBy(F.col("uid").alias("chunk_uid")).agg(F.max(F.struct("url", "text")).alias("c")).select("chunk_uid", "c.url", "c.text")
    mentions = read_table(spark, sf, "entities").withColumn("doc_seq", F.col("doc_seq").cast("long"))
    mentioned = mentions.groupBy("chunk_uid").agg(F.min("doc_seq").alias("of_mention"))
    numbered = one.join(pages, "url", "left").join(mentioned, "chunk_uid", "left").withColumn("doc_seq", F.coalesce("doc_seq", "of_mention"))
    chunks = numbered.filter("doc_seq is not null").select("doc_seq", "chunk_uid", "url", "text")
    return Corpus(chunks, annotator.tokens(chunks), graph.dedupe_entities(mentions), read_table(spark, sf, "relations"), annotator)


def chunk_pages(pages: DataFrame, limit: int = chunking.CHUNK_SIZE) -> DataFrame:
    """``doc_seq, chunk_uid, url, text``: the paragraphs of pages (``page_id, url, html``) in numbered chunks.

    A page without paragraphs gives one empty chunk, a null html none; repeated rows count once. Chunks are numbered
    over all pages in their order.
    """
    docs = pages.select(F.col("page_id").cast("long").alias("doc_seq"), "url", page_text(F.col("html")).alias("text")).filter("doc_seq is not null and text is not null")
    docs = docs.groupBy("doc_seq").agg(F.max(F.struct("url", "text")).alias("p")).select("doc_seq", "p.url", "p.text")
    cut = materialize(chunking.chunk_documents(docs, "doc_seq", limit=limit), "kg-cut")
    numbered = chunking.number_chunks(cut).select(F.col("doc_id").alias("doc_seq"), F.col("uid").alias("chunk_uid"), "text")
    return materialize(numbered.join(docs.select("doc_seq", "url"), "doc_seq").select("doc_seq", "chunk_uid", "url", "text"), "kg-chunks")


def annotated(chunks: DataFrame, annotator: annotate.Annotator) -> Corpus:
    """A corpus whose entities and relations the annotator finds: names first, then noun chunks at other places."""
    toks = materialize(annotator.tokens(chunks), "kg-all-tokens")
    columns = ["doc_seq", "chunk_uid", "sent_id", "span_start", "span_end", "key", "text"]
    spans = annotator.named_entities(toks).select(*columns, "label").unionByName(annotator.noun_chunks(toks).select(*columns, F.lit(None).cast("string").alias("label")))
    ents = materialize(graph.dedupe_entities(spans.withColumn("loaded_at", F.lit(None).cast("timestamp"))), "kg-found")
    found = annotator.relations(ents).filter("label <> 'no_relation'")
    order = "row_number() over (partition by chunk_uid order by h_start, h_end, t_start, t_end, label) - 1 as rel_seq"
    rels = found.selectExpr("chunk_uid", order, "h_start", "h_end", "t_start", "t_end", "label", "score")
    return Corpus(chunks, toks, ents, rels)


def corpus_from_pages(pages: DataFrame, annotator: annotate.Annotator) -> Corpus:
    """From pages to an annotated corpus: paragraphs, chunks, tokens, entities and relations."""
    return annotated(chunk_pages(pages), annotator)


@dataclass
class Graph:
    corpus: Corpus
    events: DataFrame
    dictionary: DataFrame
    nodes: DataFrame
    edges: DataFrame


def lexical_graph(corpus: Corpus, with_edges: bool = True) -> Graph:
    """Dictionary, nodes and resolved edges of all documents."""
    ents = with_missing_ends(corpus)
    nouns = corpus.tokens.filter(F.col("pos").isin("NOUN", "PROPN"))
    evs = materialize(graph.events(nouns, ents), "kg-occurrences")
    words = graph.dictionary(evs)
    evs = materialize(graph.identified(evs, words), "kg-events")
    corpus = replace(corpus, entities=ents)
    ns = graph.nodes(evs)
    if not with_edges:
        return Graph(corpus, evs, words, ns, None)
    ns = materialize(ns, "kg-nodes")
    by_id = evs.withColumn("key", F.col("node_id")).withColumn("promoted", F.lit(True))
    named = by_id.filter("phase > 1")
    follows = graph.lookback_edges(by_id.filter("phase = 1").withColumnRenamed("a", "tok_i"))
    edges = graph.resolve_edges(follows, graph.compound_edges(ns, "node_id"), graph.cooccurrence_edges(named), graph.relation_edges(corpus.relations, named))
    return Graph(corpus, evs, words, ns, edges)


def missing_entities(corpus: Corpus) -> DataFrame:
    """Ends of relations that are no entity, as entities; only the tokens of their chunks are looked at."""
    missing = graph.missing_ends(corpus.relations, corpus.entities)
    return graph.backfilled(missing, corpus.tokens_of(missing.select("chunk_uid").distinct()))


def with_missing_ends(corpus: Corpus) -> DataFrame:
    """The corpus's entities, and ends of relations that are none."""
    known = replace(corpus, entities=materialize(corpus.entities, "kg-entities"))
    return known.entities.withColumn("made", F.lit(None).cast("int")).unionByName(missing_entities(known))


def build_kg(corpus: Corpus) -> dict[str, DataFrame]:
    """All frames of the graph: ``lex_nodes, lex_edges, ranked, dictionary, kg_nodes, kg_edges, within, bags``."""
    g = lexical_graph(corpus)
    edges = materialize(g.edges, "kg-edges")
    striped = materialize(rank.rank_stripes(g.nodes, rank.pagerank(g.nodes, edges)), "kg-ranks")
    ranked = rank.textrank(striped)
    return {
        "lex_nodes": striped, "lex_edges": edges, "ranked": ranked, "dictionary": g.dictionary, "kg_nodes": overlay.overlay_nodes(g.nodes, g.corpus.chunks),
        "kg_edges": overlay.overlay_edges(g.nodes, edges), "within": overlay.within_edges(ranked), "bags": graph.sentence_bags(g.corpus.entities),
    }


def graph_links(parts: dict[str, DataFrame]) -> DataFrame:
    """``src, dst, rel, prob, weight``: the edges between entities and those to their chunks."""
    between = parts["kg_edges"].select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "rel", "prob", F.lit(None).cast("double").alias("weight"))
    return between.unionByName(parts["within"].select("src", "dst", "rel", F.lit(None).cast("double").alias("prob"), "weight"))


def construct(corpus: Corpus, out: str, page: str | None = None) -> dict[str, DataFrame]:
    """Builds the graph and writes all of it under ``out``: chunk table with vectors, nodes and links as lines of JSON,
    embeddings of entities; and, if asked for and small enough, a page that shows the overlay. Gives the frames.
    """
    parts = build_kg(corpus)
    sinks.create_chunk_table(corpus.chunks.select(F.col("chunk_uid").alias("uid"), "url", "text"), f"{out}/chunks")
    links = graph_links(parts)
    sinks.graph_json(parts["kg_nodes"], links).write.mode("overwrite").partitionBy("part").text(f"{out}/graph")
    model = vectors.train_entities(parts["bags"])
    if model is not None:
        sinks.save_embeddings(model, f"{out}/embeddings")
    if page:
        n_docs = corpus.chunks.select(F.countDistinct("doc_seq")).first()[0]
        sinks.write_html(overlay.viz_overlay(parts["kg_nodes"], max(n_docs, 1)), links, page)
    return parts


def main(spark: SparkSession, pages: DataFrame, out: str, annotator: annotate.Annotator | None = None, page: str | None = None) -> dict[str, DataFrame]:
    """From pages (``page_id, url, html``) to all that is written of their graph."""
    return construct(corpus_from_pages(pages, annotator or annotate.RuleAnnotator()), out, page)
