"""The graph's closed form against a step-by-step restatement on random corpora, ranks against loops, and edge cases."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from sparkweave.operators import communities, components, graph, overlay, rank, skew, vectors
from sparkweave.operators.ordered_ids import ordered_ids
from sparkweave.plans import kg

TOKENS = "doc_seq long, chunk_uid long, sent_id int, tok_i int, text string, pos string, key string"
MENTIONS = "doc_seq long, chunk_uid long, span_start int, span_end int, key string, text string, label string, sent_id int, loaded_at timestamp"
RELATIONS = "chunk_uid long, rel_seq int, h_start int, h_end int, t_start int, t_end int, label string, score double"


def corpus(rng: random.Random, docs: int = 3):
    toks, ents, rels, uid = [], [], [], 0
    for doc in range(docs):
        for _ in range(rng.randrange(1, 3)):
            at, spans = 0, []
            for sent in range(rng.randrange(1, 4)):
                begin = at
                for _ in range(rng.randrange(0, 6)):
                    pos = rng.choice(["NOUN", "NOUN", "PROPN", "VERB", "PRON"])
                    word = rng.choice("abcde") if pos != "PRON" else rng.choice(["it", "he"])
                    toks.append((doc, uid, sent, at, word.upper(), pos, f"{pos}.{word}"))
                    at += 1
                own = [t for t in toks if t[1] == uid and t[3] >= begin]
                for _ in range(rng.randrange(0, 4)):
                    if own:
                        i = rng.randrange(len(own))
                        part = own[i : i + rng.choice([1, 1, 2])]
                        span = (part[0][3], part[-1][3] + 1)
                        if span not in [s[:2] for s in spans]:
                            spans.append((*span, " ".join(t[6] for t in part), " ".join(t[4] for t in part), rng.choice(["NP", "Food", "Organ"]), sent))
            ents += [(doc, uid, a, b, k, t, lab, s, None) for a, b, k, t, lab, s in spans]
            if len(spans) > 1:
                rels += [(uid, i, *h[:2], *t[:2], rng.choice(["parent", "followed by"]), rng.choice([0.4, 0.9, 0.9])) for i in range(rng.randrange(0, 3)) for h, t in [rng.sample(spans, 2)]]
            if spans and rng.random() < 0.6:  # an end that is no entity, maybe a stop key
                sent = rng.choice(spans)
                free = [t for t in toks if t[1] == uid and (t[3], t[3] + 1) not in [s[:2] for s in spans]]
                if free:
                    t = rng.choice(free)
                    ends = [sent[:2], (t[3], t[3] + 1)]
                    rng.shuffle(ends)
                    rels.append((uid, 9, *ends[0], *ends[1], "child", rng.choice([0.3, 0.7])))
            uid += 1
    return toks, ents, rels


def stepwise(toks, ents, rels):
    """What the pipeline does, one record at a time, with growing dictionaries."""
    known: list[str] = []
    nodes: dict = {}
    edges: dict = {}
    ident = lambda key: known.index(key) if key in known else (known.append(key), len(known) - 1)[1]
    for doc in sorted({t[0] for t in toks} | {e[0] for e in ents}):
        for uid in sorted({t[1] for t in toks if t[0] == doc} | {e[1] for e in ents if e[0] == doc}):
            pair = lambda a, b: (doc, min(a, b), max(a, b))
            for sent in sorted({t[2] for t in toks if t[1] == uid}):
                seq = []
                for t in sorted((t for t in toks if t[1] == uid and t[2] == sent and t[5] in ("NOUN", "PROPN")), key=lambda t: t[3]):
                    i = ident(t[6])
                    n = nodes.setdefault((doc, i), {"key": t[6], "kind": "Lemma", "label": None, "pos": t[5], "text": t[4], "chunk": uid, "count": 0})
                    n["count"] += 1
                    seq.append(i)
                for hop in range(3):
                    for a, b in zip(seq, seq[hop + 1 :]):
                        edges.setdefault(pair(a, b), ("FOLLOWS_LEXICALLY", None))
            own = [e for e in ents if e[1] == uid and e[4] not in graph.STOP_KEYS]
            for e in sorted(own, key=lambda e: (e[6] == "NP", e[2], e[3])):
                new_word = e[4] not in known
                i = ident(e[4])
                if (doc, i) not in nodes:
                    nodes[doc, i] = {"key": e[4], "kind": "Entity", "label": e[6], "pos": "NP", "text": e[5], "chunk": uid, "count": 1}
                    for part in e[4].split(" "):
                        if part in known and (doc, known.index(part)) in nodes:
                            edges[pair(i, known.index(part))] = ("COMPOUND_ELEMENT_OF", None)
                    if new_word:
                        continue
                n = nodes[doc, i]
                n["kind"], n["chunk"] = "Entity", uid
                n["count"] += 1
                if n["label"] in (None, "NP"):
                    n["label"] = e[6]
            at = {(e[2], e[3]): known.index(e[4]) for e in own}
            made = {(e[2], e[3]) for e in ents if e[1] == uid}
            for r in sorted((r for r in set(rels) if r[0] == uid), key=lambda r: (-r[7], r[1], *r[2:6], r[6])):
                for span in (r[2:4], r[4:6]):
                    if span in made:
                        continue
                    made.add(span)
                    part = [t for t in toks if t[1] == uid and span[0] <= t[3] < span[1]]
                    key, text = " ".join(t[6] for t in part), " ".join(t[4] for t in part)
                    if key in graph.STOP_KEYS:
                        continue
                    e = (doc, uid, *span, key, text, "", part[0][2])
                    own.append(e)
                    new_word = key not in known
                    i = at[span] = ident(key)
                    if (doc, i) not in nodes:
                        nodes[doc, i] = {"key": key, "kind": "Entity", "label": "", "pos": "NP", "text": text, "chunk": uid, "count": 1}
                        for x in key.split(" "):
                            if x in known and (doc, known.index(x)) in nodes:
                                edges[pair(i, known.index(x))] = ("COMPOUND_ELEMENT_OF", None)
                        if new_word:
                            continue
                    n = nodes[doc, i]
                    n["kind"], n["chunk"] = "Entity", uid
                    n["count"] += 1
                    if n["label"] in (None, "NP"):
                        n["label"] = ""
                if r[2:4] in at and r[4:6] in at:
                    edges[pair(at[r[2:4]], at[r[4:6]])] = (r[6].replace(" ", "_").upper(), round(r[7], 3))
            for sent in sorted({e[7] for e in own}):
                ids = sorted({known.index(e[4]) for e in own if e[7] == sent})
                for x, a in enumerate(ids):
                    for b in ids[x + 1 :]:
                        edges.setdefault(pair(a, b), ("CO_OCCURS_WITH", 1.0))
    return {(d, i): tuple(n.values()) for (d, i), n in nodes.items()}, edges


def test_closed_form(spark):
    rng = random.Random(11)
    for _ in range(6):
        docs = rng.randrange(2, 9)
        toks, mentions, rels = corpus(rng, docs)
        t, e, r = spark.createDataFrame(toks, TOKENS), spark.createDataFrame(mentions, MENTIONS), spark.createDataFrame(rels, RELATIONS)
        ents = graph.dedupe_entities(e).cache()
        evs = graph.events(t, ents).cache()
        g = kg.lexical_graph(kg.Corpus(t.select("doc_seq", "chunk_uid").distinct(), t, ents, r))
        ns, edges = g.nodes, g.edges
        assert {x.key for x in graph.dictionary(evs).collect()} <= {x.key for x in ns.collect()}
        want_nodes, want_edges = stepwise(toks, mentions, rels)
        got_nodes = {(x.doc_seq, x.node_id): (x.key, x.kind, x.label, x.pos, x.text, x.chunk_uid, x["count"]) for x in ns.collect()}
        # a lemma's chunk isn't looked at by anything that follows
        skip = lambda ns: {k: v[:5] + (v[5] if v[1] == "Entity" else None,) + v[6:] for k, v in ns.items()}
        assert skip(got_nodes) == skip(want_nodes)
        assert {(x.doc_seq, x.src, x.dst): (x.rel, x.prob) for x in edges.collect()} == want_edges


def test_backfill(spark):
    """Ends without tokens, with nulls, repeated, and of stop keys."""
    t = spark.createDataFrame([(0, 1, 0, 0, "Red", "NOUN", "NOUN.red"), (0, 1, 0, 1, "barley", "NOUN", "NOUN.barley"), (0, 1, 1, 2, "it", "PRON", "PRON.it")], TOKENS)
    e = graph.dedupe_entities(spark.createDataFrame([(0, 1, 0, 1, "NOUN.red", "Red", "NP", 0, None)], MENTIONS))
    rels = [(1, 0, 0, 1, 0, 2, "parent", 0.5), (1, 0, 0, 1, 0, 2, "parent", 0.5), (1, 1, 2, 3, 0, 1, "child", 0.9), (1, 2, 7, 9, 0, 1, "child", None), (1, 3, None, 3, 0, 1, "child", 0.1), (None, 4, 0, 9, 0, 1, "child", 0.1)]
    missing = graph.missing_ends(spark.createDataFrame(rels, RELATIONS), e)
    assert sorted((r.chunk_uid, r.span_start, r.span_end) for r in missing.collect()) == [(1, 0, 2), (1, 2, 3), (1, 7, 9)]
    got = {(r.key, r.text, r.label, r.promoted, r.sent_id) for r in graph.backfilled(missing, t).collect()}
    assert got == {("NOUN.red NOUN.barley", "Red barley", "", True, 0), ("PRON.it", "it", "", False, 1)}
    assert graph.backfilled(missing.limit(0), t).count() == 0


def test_lookback(spark):
    for seq, want in (("abcde", "ab bc cd de ac bd ce ad be"), ("a", ""), ("aa", "aa"), ("aba", "ab aa")):
        t = spark.createDataFrame([(0, 0, 0, i, c, "NOUN", c) for i, c in enumerate(seq)], TOKENS)
        assert sorted(x.ka + x.kb for x in graph.lookback_edges(t).collect()) == sorted(want.split())


def test_pronoun_keys(spark):
    words = spark.createDataFrame([("PRON.he", 0), ("NOUN.barley", 1), ("ADJ.red PRON.she", 2), (None, 3)], "key string, node_id long")
    assert sorted(r.node_id for r in overlay.pronoun_keys(words).collect()) == [0, 2]


def test_dedupe_edges(spark):
    rows = [(0, 1, 0, 1, "NOUN.x", "x", None, 0, None), (0, 1, 0, 1, "NOUN.x", "x", "Food", 0, None), (0, 1, 2, 3, "PRON.it", "it", "NP", 0, None), (0, 1, 3, 4, None, "q", "NP", 0, None), (0, None, 3, 4, "k", "q", "NP", 0, None)]
    got = {r.key: (r.label, r.promoted) for r in graph.dedupe_entities(spark.createDataFrame(rows, MENTIONS)).collect()}
    assert got == {"NOUN.x": ("Food", True), "PRON.it": ("NP", False)}
    assert graph.dedupe_entities(spark.createDataFrame([], MENTIONS)).count() == 0


def test_pagerank(spark):
    ns = spark.createDataFrame([(0, i) for i in (3, 5, 7, 9)] + [(1, 2)], "doc_seq long, node_id long")
    es = spark.createDataFrame([(0, 3, 5), (0, 5, 7), (0, 7, 7)], "doc_seq long, src long, dst long")
    got = {(r.doc_seq, r.node_id): r.pagerank for r in rank.pagerank(ns, es).collect()}
    near = {0: [1], 1: [0, 2], 2: [1, 2], 3: []}
    r = np.full(4, 0.25)
    for _ in range(20):
        n = np.full(4, 0.15 / 4)
        for a, bs in near.items():
            for b in bs or range(4):
                n[b] += 0.85 * r[a] / len(bs or range(4))
        r = n
    assert np.allclose([got[0, i] for i in (3, 5, 7, 9)], r, atol=1e-12) and abs(got[1, 2] - 1) < 1e-12


def test_bins_and_stripes(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 10, 20, 50, 100, 1000, 10000)], "n int")
    assert [len(r[0]) for r in df.select(rank.bins(F.col("n"))).collect()] == [1, 3, 4, 6, 6, 9, 12, 16, 18, 28, 37]
    v = spark.createDataFrame([([0.1, 0.1, 0.5, 1.0], x) for x in (0.1, 0.1, 0.5, 1.0)], "vs array<double>, x double")
    points = F.array(*[F.lit(i / 5) for i in range(6)])
    assert [r[0] for r in v.select(rank.stripe(F.col("x"), rank.quantiles(F.col("vs"), points))).collect()] == [2, 2, 4, 5]


def test_one_node_document(spark):
    ns = spark.createDataFrame([(0, 1, "Entity", "k", "t", "Food", 4, 2)], "doc_seq long, node_id long, kind string, key string, text string, label string, chunk_uid long, count long")
    r = rank.rank_stripes(ns, rank.pagerank(ns, spark.createDataFrame([], "doc_seq long, src long, dst long"))).first()
    assert r["rank"] == 1.0


def test_overlay(spark):
    ns = spark.createDataFrame([(d, i, "Entity", f"k{i}", f"t{i}{d}", "Food", d, 2) for d in (1, 2) for i in (0, 1)], "doc_seq long, node_id long, kind string, key string, text string, label string, chunk_uid long, count long")
    es = spark.createDataFrame([(1, 0, 1, "PARENT", 0.4), (2, 0, 1, "CHILD", 0.8), (2, 0, 0, "FOLLOWS_LEXICALLY", None)], "doc_seq long, src long, dst long, rel string, prob double")
    assert [tuple(r) for r in overlay.overlay_edges(ns, es).collect()] == [(0, 1, "PARENT", 0.8)]
    assert {(r.node_id, r.text, r["count"]) for r in overlay.entity_nodes(ns).collect()} == {(0, "t01", 4), (1, "t11", 4)}
    sizes = spark.createDataFrame([("e", "Entity", 1), ("f", "Entity", 100)], "id string, kind string, count long").withColumns({c: F.lit("x") for c in ("text", "key", "url")})
    assert [r.size for r in overlay.viz_overlay(sizes, 1).orderBy("id").collect()][0] == 14
    assert [r.size for r in overlay.viz_overlay(sizes, 2).orderBy("id").collect()] == [8, 36]


def test_components_and_labels(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("x", "y"), ("y", "y"), (None, "z")]
    nodes = spark.createDataFrame([(f"n{i:03}",) for i in range(41)] + [("x",), ("y",), ("z",)], "node string")
    got = {r.node: r.component for r in components.connected_components(nodes, spark.createDataFrame(chain, "a string, b string")).collect()}
    assert {got[f"n{i:03}"] for i in range(41)} == {"n000"} and got["y"] == "x" and got["z"] == "z"
    hub = spark.createDataFrame([("h", f"m{i}") for i in range(3000)], "a string, b string")
    got = components.connected_components(hub.select(F.col("b").alias("node")), hub).collect()
    assert len(got) == 3000 and {r.component for r in got} == {"h"}
    assert components.connected_components(nodes.limit(0), hub.limit(0)).count() == 0
    two = [(a, b) for g in ((0, 1, 2), (5, 6, 7)) for a in g for b in g if a < b] + [(2, 5)]
    got = {r.node: r.community for r in communities.label_propagation(spark.createDataFrame(two, "src long, dst long")).collect()}
    assert got[0] == got[1] and got[6] == got[7] and got[0] != got[7]


def test_skew_and_ids(spark):
    left = spark.createDataFrame([(("hot" if i % 3 else f"k{i}"), i) for i in range(6000)] + [(None, -1)], "k string, v int")
    right = skew.dense_dictionary(left, "k")
    out = skew.skew_lookup(left, right, "k", "n_rows", F.col("v"))
    assert out.count() == 6000 and out.select("v").distinct().count() == 6000
    ids = sorted(r.id for r in right.collect())
    assert ids == list(range(len(ids)))
    numbered = ordered_ids(spark.range(0, 1000).selectExpr("1000 - id as x"), ["x"], "n").collect()
    assert all(r.n == r.x - 1 for r in numbered)


def test_vectors(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([(1, 0), (0, 1), (-1, 0), (1, 1), (1, 0)])]
    df = spark.createDataFrame([*rows, (9, None), (10, [1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vectors.search(df, [1.0, 0.0], 3).collect()] == [0, 4, 3]
    assert [r.vec_id for r in vectors.neighbours(df, [1.0, 0.0], 4).collect()] == [0, 4, 3]
    t = spark.createDataFrame([(1, "red barley and rye"), (2, "sleep"), (3, None)], "uid long, t string").withColumn("vector", vectors.embed(F.col("t")))
    assert vectors.search_text(t, "Rye and red barley", 1).first().uid == 1
    e = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(vectors.embed(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in e[0].v) - 1) < 1e-6 and set(e[1].v) == {0.0} and e[2].v is None
