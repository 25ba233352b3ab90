"""Queries over the smallest tables, sinks, and the stream."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkweave import session
from sparkweave.operators import annotate, overlay, vectors
from sparkweave.plans import kg, registry
from sparkweave.sources import sinks
from sparkweave.streaming.ingest import stream_chunks

DATA = "/root/testdata/sf0.001"


def test_noun_chunks(spark):
    chunks = spark.createDataFrame([(0, 1, "The small red barley was with Anna Lund.\n\nIt fell by 12 points"), (0, 2, None), (0, 3, "")], "doc_seq long, chunk_uid long, text string")
    toks = annotate.tokens(chunks)
    got = {(r.span_start, r.span_end, r.key) for r in annotate.noun_chunks(toks).collect()}
    assert (6, 8, "PROPN.anna PROPN.lund") in got and (8, 9, "PRON.it") in got and (11, 13, "NUM.12 NOUN.point") in got


def test_any_type_relation(spark):
    """An empty list of types allows any: every ordered pair is a candidate for no_relation, of untyped entities too."""
    ents = spark.createDataFrame([(1, 0, 0, 1, "Person"), (1, 0, 2, 3, "Company"), (1, 0, 4, 5, "NP"), (1, 1, 6, 7, "Food")], "chunk_uid long, sent_id int, span_start int, span_end int, label string")
    got = {(r.h_start, r.t_start, r.label) for r in annotate.relation_candidates(ents).collect()}
    assert {(h, t) for h, t, label in got if label == "no_relation"} == {(h, t) for h in (0, 2, 4) for t in (0, 2, 4) if h != t}
    assert {(h, t) for h, t, label in got if label != "no_relation"} == {(0, 2), (2, 0)} and (0, 2, "founder") in got


def test_page_refuses_large_graphs(spark, tmp_path):
    viz = spark.createDataFrame([(str(i), 5, f"n{i}", None) for i in range(4)], "id string, size int, label string, title string")
    edges = spark.createDataFrame([("0", "1", "r")], "src string, dst string, rel string")
    sinks.write_html(viz, edges, str(tmp_path / "g.html"), most=4)
    assert (tmp_path / "g.html").read_text().count("<tr>") == 4
    with pytest.raises(ValueError):
        sinks.write_html(viz, edges, str(tmp_path / "h.html"), most=3)
    with pytest.raises(ValueError):
        sinks.write_html(viz.limit(0), edges.union(edges), str(tmp_path / "h.html"), most=1)


def test_names_agree():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_build(spark, tmp_path):
    parts = kg.build_kg(kg.load_corpus(spark, DATA))
    ranks = parts["lex_nodes"].groupBy("doc_seq").agg(F.sum("rank").alias("r"), F.sum("pagerank").alias("p")).collect()
    assert ranks and all(abs(x.r - 1) < 1e-9 and abs(x.p - 1) < 1e-6 for x in ranks)
    assert parts["kg_edges"].filter(F.col("rel").isin("FOLLOWS_LEXICALLY", "COMPOUND_ELEMENT_OF")).count() == 0
    ids = parts["kg_nodes"].select(F.col("id").alias("dst"))
    assert parts["within"].join(ids, "dst", "left_anti").count() == 0
    sinks.write_node_link(parts["kg_nodes"], parts["kg_edges"], str(tmp_path / "kg.json"))
    whole = json.loads((tmp_path / "kg.json").read_text())
    assert len(whole["nodes"]) == parts["kg_nodes"].count() and len(whole["links"]) == parts["kg_edges"].count()


def test_chunks_without_url(spark, tmp_path):
    """They and their mentions and relations are in the graph, under the number their mentions have."""
    tables = {
        "urls": ([(0, "u")], "doc_seq int, url string"),
        "text_chunk": ([(1, "u", "Anna Lund ate barley"), (2, None, "Anna Lund ate rye"), (2, None, "Anna Lund ate rye"), (3, None, "No mention stands here"), (4, "u", None)], "uid long, url string, text string"),
        "entities": ([(d, u, 0, 2, "PROPN.anna PROPN.lund", "Anna Lund", "Person", 0, 7, None) for d, u in [(0, 1), (5, 2)]] + [(5, 2, 3, 4, "NOUN.rye", "rye", "Food", 0, 8, None)],
                     "doc_seq int, chunk_uid long, span_start int, span_end int, key string, text string, label string, sent_id int, node_id long, loaded_at timestamp"),
        "relations": ([(2, 0, 0, 2, 3, 4, "spouse", 0.5)], "chunk_uid long, rel_seq int, h_start int, h_end int, t_start int, t_end int, label string, score double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    corpus = kg.load_corpus(spark, str(tmp_path))
    assert sorted((r.doc_seq, r.chunk_uid, r.url) for r in corpus.chunks.collect()) == [(0, 1, "u"), (5, 2, None)]
    assert sorted((r.chunk_uid, r.key) for r in corpus.entities.collect()) == [(1, "PROPN.anna PROPN.lund"), (2, "NOUN.rye"), (2, "PROPN.anna PROPN.lund")]
    assert registry.relation_edges(spark, str(tmp_path)).count() == 1
    g = kg.lexical_graph(corpus, with_edges=False)
    assert {(r.id, r.url) for r in overlay.overlay_nodes(g.nodes, corpus.chunks).filter("kind = 'Chunk'").collect()} == {("chunk_1", "u"), ("chunk_2", None)}


def test_pages_to_graph(spark, tmp_path):
    """From pages to all files: repeated and empty pages, null html, extra columns, another annotator."""
    html = "<p>Anna Lund of Kelp Works ate red barley.</p><p>It was said that Anna Lund met Otto Berg in the red barley.</p>"
    rows = [(1, "u", html), (1, "u", html), (2, "v", None), (3, "w", ""), (4, None, "<p>No red barley was with Otto Berg.</p>"), (None, "x", html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' as text", "1 as doc_seq")
    names = spark.createDataFrame([("anna lund", "Person"), ("kelp works", "Company"), ("otto berg", "Person")], "name string, label string")
    parts = kg.main(spark, pages, str(tmp_path / "out"), annotate.RuleAnnotator(names), str(tmp_path / "g.html"))
    nodes = {r.key: (r.text, r.label, r["count"]) for r in parts["kg_nodes"].filter("kind = 'Entity'").collect()}
    assert nodes["PROPN.otto PROPN.berg"][:2] == ("Otto Berg", "Person") and "PRON.it" not in nodes
    assert parts["kg_nodes"].filter("kind = 'Chunk'").count() == 3
    rel = {r.rel for r in parts["kg_edges"].collect()}
    assert rel & {"PARENT", "SPOUSE", "CHILD", "FOLLOWED_BY"} and "NO_RELATION" not in rel
    lines = spark.read.text(str(tmp_path / "out/graph"))
    assert lines.filter("part = 'node'").count() == parts["kg_nodes"].count() and "Otto Berg" in (tmp_path / "g.html").read_text()
    assert sinks.open_chunk_table(spark, str(tmp_path / "out/chunks")).count() == 3
    saved = sinks.load_embeddings(spark, str(tmp_path / "out/embeddings"))
    model = vectors.train_entities(parts["bags"])
    assert {r.key: r.vector for r in saved.collect()} == {r.word: list(r.vector) for r in model.getVectors().collect()}
    near = vectors.entity_neighbours(saved, "PROPN.otto PROPN.berg", 3).collect()
    assert all(r.similarity > 0 and r.key != "PROPN.otto PROPN.berg" for r in near) and vectors.entity_neighbours(saved, "nobody").count() == 0

    class Words(annotate.RuleAnnotator):
        def noun_chunks(self, toks):
            return super().noun_chunks(toks).limit(0)

    only = kg.corpus_from_pages(pages, Words(names))
    assert {r.key for r in only.entities.collect()} == {"PROPN.anna PROPN.lund", "PROPN.otto PROPN.berg"} | ({"PROPN.kelp PROPN.works"} & {r.key for r in only.entities.collect()})
    assert kg.lexical_graph(kg.corpus_from_pages(pages.limit(0), annotate.RuleAnnotator())).edges.count() == 0


def test_pairwise_relations(spark):
    spans = [(1, 0, 0, 2, "PROPN.anna PROPN.lund", "Anna Lund"), (1, 0, 3, 5, "PROPN.kelp PROPN.works", "Kelp Works"), (1, 0, 6, 7, "PROPN.kelp", "Kelp"), (1, 0, 30, 31, "NOUN.far", "far"), (1, 1, 40, 41, "NOUN.rye", "rye")]
    df = spark.createDataFrame(spans + spans[:1], "chunk_uid long, sent_id int, span_start int, span_end int, key string, text string").selectExpr("*", "1 as label2")
    names = spark.createDataFrame([("anna lund", "Person"), ("kelp works", "Company")], "name string, label string")
    got = {(r.h_start, r.t_start): r.label for r in annotate.pairwise_relations(df, names).collect()}
    assert got == {(0, 3): "co_founder", (0, 6): "no_relation"}
    assert annotate.pairwise_relations(df.limit(0), names).count() == 0


def test_released_and_diagnosed(spark):
    with session.released():
        table = session.materialize(spark.range(5), "t")
        n, seen = session.diagnosed(spark, table.count)
        path = session._written[-1][1]
    assert n == 5 and seen["seconds"] >= 0 and seen["master"].startswith("local") and seen["jvm_used_mb"] > 0
    assert not os.path.exists(path.removeprefix("file://"))


def test_shared_folder_is_asked_for():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError):
        session.shared_dir(Session)


def test_stream_and_chunk_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>One. Two.</p><p>Three.</p>"), (2, "v", None), (3, "w", "")], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    stream_chunks(spark.readStream.schema(pages.schema).parquet(str(tmp_path / "pages")), str(tmp_path / "chunks"), str(tmp_path / "cp")).awaitTermination()
    rows = {r.doc_id: r for r in sinks.open_chunk_table(spark, str(tmp_path / "chunks")).collect()}
    assert rows[1].text == "One.\nTwo.\nThree." and len(rows[1].vector) == 64 and set(rows) == {1, 3}
