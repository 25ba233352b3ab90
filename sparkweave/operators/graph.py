"""The lexical graph in closed form: dictionary, nodes and edges of all documents at once.

An event is an occurrence of a key, ordered by ``(doc_seq, chunk_uid, phase, a, b)``: phase 1 tokens by place, 2 names
and 3 noun chunks by span, and 4 ends of relations that were no entity before, by the relation's rank. What the reference
does step by step, first or last one wins, is a ``min_by`` over events. Each event gets its key's id once; nodes and
edges are made of ids alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.functions.text import relation_label
from sparkweave.operators.ordered_ids import ordered_ids
from sparkweave.operators.skew import skew_lookup

LOOKBACK = 3
#: Keys that are never promoted to entities.
STOP_KEYS = ["PRON.it", "PRON.that", "PRON.they", "PRON.those", "PRON.we", "PRON.which", "PRON.who"]
ORD = ["doc_seq", "chunk_uid", "phase", "a", "b"]
FOLLOWS, COMPOUND, TOGETHER = "FOLLOWS_LEXICALLY", "COMPOUND_ELEMENT_OF", "CO_OCCURS_WITH"


def dedupe_entities(mentions: DataFrame) -> DataFrame:
    """One row per span of a chunk: with a label before without, then the first loaded; ``promoted`` is false for stop keys.

    Rows without chunk, span or key are left out; a missing label counts as NP.
    """
    known = mentions.filter("chunk_uid is not null and span_start is not null and span_end is not null and key is not null and doc_seq is not null")
    first = F.min_by(F.struct("doc_seq", "key", "text", "label", "sent_id"), F.struct(F.col("label").isNull(), F.coalesce("loaded_at", F.lit("9999-12-31").cast("timestamp")), "text", "key", "doc_seq"))
    one = known.groupBy("chunk_uid", "span_start", "span_end").agg(first.alias("e"))
    return one.select("e.doc_seq", "chunk_uid", "e.sent_id", "span_start", "span_end", "e.key", "e.text", F.coalesce("e.label", F.lit("NP")).alias("label"), (~F.col("e.key").isin(STOP_KEYS)).alias("promoted"))


def relation_ranks(rels: DataFrame) -> DataFrame:
    """The different relations with ``rel_rank``, their place in their chunk by score."""
    once = rels.select("chunk_uid", "rel_seq", "h_start", "h_end", "t_start", "t_end", "label", "score").distinct()
    return once.selectExpr("*", "row_number() over (partition by chunk_uid order by score desc nulls last, rel_seq, h_start, h_end, t_start, t_end, label) as rel_rank")


def missing_ends(rels: DataFrame, ents: DataFrame) -> DataFrame:
    """``chunk_uid, span_start, span_end, made``: spans of relations that are no entity, with the order in which they come up."""
    ranked = relation_ranks(rels)
    end = lambda c, k: ranked.select("chunk_uid", F.col(f"{c}_start").alias("span_start"), F.col(f"{c}_end").alias("span_end"), (F.col("rel_rank") * 2 + k).alias("made"))
    ends = end("h", 0).unionByName(end("t", 1)).filter("chunk_uid is not null and span_start is not null and span_end is not null")
    first = ends.groupBy("chunk_uid", "span_start", "span_end").agg(F.min("made").cast("int").alias("made"))
    return first.join(ents.select("chunk_uid", "span_start", "span_end"), ["chunk_uid", "span_start", "span_end"], "left_anti")


def backfilled(missing: DataFrame, toks: DataFrame) -> DataFrame:
    """Entities, as ``dedupe_entities`` gives them with ``made``, of spans that are none: key and text of the span's
    tokens, an empty label, the first token's sentence. Spans without tokens give none."""
    places = missing.filter("span_start < span_end").withColumn("tok_i", F.explode(F.sequence("span_start", F.col("span_end") - 1)))
    found = places.join(toks.select("doc_seq", "chunk_uid", "sent_id", "tok_i", "key", "text"), ["chunk_uid", "tok_i"])
    spans = found.groupBy("doc_seq", "chunk_uid", "span_start", "span_end", "made").agg(F.array_sort(F.collect_list(F.struct("tok_i", "key", "text", "sent_id"))).alias("t"))
    key = F.array_join("t.key", " ")
    return spans.select(
        "doc_seq", "chunk_uid", F.col("t")[0]["sent_id"].alias("sent_id"), "span_start", "span_end", key.alias("key"), F.array_join("t.text", " ").alias("text"), F.lit("").alias("label"),
        (~key.isin(STOP_KEYS)).alias("promoted"), "made",
    )


def events(toks: DataFrame, ents: DataFrame) -> DataFrame:
    """All occurrences of keys; ``ents`` may have ``made`` for those that relations brought in."""
    none = lambda t: F.lit(None).cast(t)
    made = F.col("made") if "made" in ents.columns else none("int")
    lemma = toks.filter(F.col("pos").isin("NOUN", "PROPN")).select("doc_seq", "chunk_uid", F.lit(1).alias("phase"), F.col("tok_i").alias("a"), F.lit(0).alias("b"), "sent_id", "key", "text", "pos", none("string").alias("label"), none("int").alias("span_start"), none("int").alias("span_end"))
    phase = F.when(made.isNotNull(), 4).when(F.col("label") == "NP", 3).otherwise(2)
    named = ents.filter("promoted").select("doc_seq", "chunk_uid", phase.alias("phase"), F.coalesce(made, "span_start").alias("a"), F.when(made.isNotNull(), 0).otherwise(F.col("span_end")).alias("b"), "sent_id", "key", "text", F.lit("NP").alias("pos"), "label", "span_start", "span_end")
    return lemma.unionByName(named)


def dictionary(evs: DataFrame) -> DataFrame:
    """``key, node_id``: ids by first appearance over all documents, with the place of it and the number of appearances."""
    first = evs.groupBy("key").agg(F.min(F.struct(*ORD)).alias("f"), F.count(F.lit(1)).alias("n_rows")).select("key", "n_rows", *[F.col(f"f.{c}").alias(c) for c in ORD])
    return ordered_ids(first, [*ORD, "key"], "node_id", "kg-dictionary").select("key", "node_id", F.col("doc_seq").alias("first_doc"), "n_rows")


def identified(evs: DataFrame, words: DataFrame) -> DataFrame:
    """Events with ``node_id`` and ``first_doc``; frequent keys are spread."""
    return skew_lookup(evs, words, "key", "n_rows", F.struct("chunk_uid", "a"))


def nodes(evs: DataFrame) -> DataFrame:
    """``doc_seq, node_id, key, kind, label, pos, text, chunk_uid, count`` and how the node came to be, of identified events."""
    e, o = F.struct("text", "pos", "phase", "key"), F.struct(*ORD)
    named = F.col("phase") > 1
    each = evs.groupBy("doc_seq", "node_id").agg(
        F.min_by(e, o).alias("first"), F.min(o).alias("created"), F.count(F.lit(1)).alias("n"), F.max(F.when(named, F.col("chunk_uid"))).alias("last_chunk"), F.min("chunk_uid").alias("first_chunk"),
        F.min_by("label", F.when(named & (F.col("label") != "NP"), o)).alias("refined"), F.max(named).alias("entity"), F.min("first_doc").alias("first_doc"),
    )
    again = F.when((F.col("first.phase") > 1) & (F.col("first_doc") < F.col("doc_seq")), 1).otherwise(0)
    return each.select(
        "doc_seq", "node_id", "first.key", F.when(F.col("entity"), "Entity").otherwise("Lemma").alias("kind"), F.when(F.col("entity"), F.coalesce("refined", F.lit("NP"))).alias("label"),
        "first.pos", "first.text", F.coalesce("last_chunk", "first_chunk").alias("chunk_uid"), (F.col("n") + again).alias("count"), "created",
    )


# Edges are made of whatever ``key`` holds: keys themselves, or their ids.


def lookback_edges(toks: DataFrame) -> DataFrame:
    """``doc_seq, chunk_uid, ka, kb``: pairs of nouns within three places of each other among a sentence's nouns."""
    kept = toks.filter(F.col("pos").isin("NOUN", "PROPN"))
    over = "over (partition by doc_seq, chunk_uid, sent_id order by tok_i)"
    ahead = kept.selectExpr("doc_seq", "chunk_uid", "key as ka", f"array({', '.join(f'lead(key, {h}) {over}' for h in range(1, LOOKBACK + 1))}) as next")
    pairs = ahead.select("doc_seq", "chunk_uid", "ka", F.explode("next").alias("kb")).filter("kb is not null")
    return pairs.select("doc_seq", F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"), "chunk_uid").groupBy("doc_seq", "ka", "kb").agg(F.min("chunk_uid").alias("chunk_uid"))


def compound_edges(ns: DataFrame, named_by: str = "key") -> DataFrame:
    """``doc_seq, ka, kb``: an entity that made its own node, with those of its parts that were nodes by then."""
    made = ns.filter("created.phase > 1").select("doc_seq", F.col(named_by).alias("whole"), F.col("created").alias("at"), F.explode(F.array_distinct(F.split("key", " "))).alias("key"))
    parts = made.join(ns.select("doc_seq", "key", F.col(named_by).alias("part"), "created"), ["doc_seq", "key"]).filter("created <= at")
    return parts.select("doc_seq", F.least("whole", "part").alias("ka"), F.greatest("whole", "part").alias("kb")).distinct()


def cooccurrence_edges(ents: DataFrame) -> DataFrame:
    """``doc_seq, ka, kb, chunk_uid``: entities of one sentence, each pair once, with its first chunk."""
    e = ents.filter("promoted and sent_id is not null").select("doc_seq", "chunk_uid", "sent_id", "key").distinct()
    pairs = e.withColumnRenamed("key", "ka").join(e.withColumnRenamed("key", "kb"), ["doc_seq", "chunk_uid", "sent_id"]).filter("ka < kb")
    return pairs.groupBy("doc_seq", "ka", "kb").agg(F.min("chunk_uid").alias("chunk_uid"))


def relation_edges(rels: DataFrame, ents: DataFrame) -> DataFrame:
    """``doc_seq, ka, kb, chunk_uid, rel_rank, rel, prob``: relations between promoted entities, ranked by score in their chunk."""
    ranked = relation_ranks(rels)
    e = ents.filter("promoted")
    h = e.select("chunk_uid", F.col("span_start").alias("h_start"), F.col("span_end").alias("h_end"), F.col("key").alias("hk"), "doc_seq")
    t = e.select("chunk_uid", F.col("span_start").alias("t_start"), F.col("span_end").alias("t_end"), F.col("key").alias("tk"))
    both = ranked.join(h, ["chunk_uid", "h_start", "h_end"]).join(t, ["chunk_uid", "t_start", "t_end"])
    return both.select("doc_seq", F.least("hk", "tk").alias("ka"), F.greatest("hk", "tk").alias("kb"), "chunk_uid", "rel_rank", relation_label(F.col("label")).alias("rel"), F.bround("score", 3).alias("prob"))


def resolve_edges(follows: DataFrame, compounds: DataFrame, together: DataFrame, related: DataFrame) -> DataFrame:
    """``doc_seq, src, dst, rel, prob``: one edge per pair of a document's nodes; ends are ids.

    The last relation wins, which is the lowest scored of the last chunk; else a compound edge; else what came first.
    Relations are few and joined to the rest, which is summed as numbers only.
    """
    pair, null = ["doc_seq", "ka", "kb"], F.lit(None).cast("long")
    shape = lambda df, f, t, c: df.select(*pair, f.alias("f"), t.alias("t"), F.lit(c).alias("c"))
    every = shape(follows, F.col("chunk_uid"), null, 0).unionByName(shape(together, null, F.col("chunk_uid"), 0)).unionByName(shape(compounds, null, null, 1))
    plain = every.groupBy(*pair).agg(F.min("f").alias("f"), F.min("t").alias("t"), F.max("c").alias("c"))
    last = related.groupBy(*pair).agg(F.min_by(F.struct("rel", "prob"), F.struct(-F.col("chunk_uid"), -F.col("rel_rank"))).alias("r"))
    both = plain.join(last, pair, "full")
    follow = F.coalesce(F.col("f") <= F.col("t"), F.col("t").isNull())
    rel = F.when(F.col("r").isNotNull(), F.col("r.rel")).when(F.col("c") == 1, COMPOUND).when(follow, FOLLOWS).otherwise(TOGETHER)
    prob = F.when(F.col("r").isNotNull(), F.col("r.prob")).when((F.col("c") == 0) & ~follow, 1.0)
    return both.select("doc_seq", F.col("ka").alias("src"), F.col("kb").alias("dst"), rel.alias("rel"), prob.alias("prob"))


def sentence_bags(ents: DataFrame) -> DataFrame:
    """``chunk_uid, sent_id, bag``: of each sentence its number and its promoted entities' keys in order."""
    kept = ents.filter("promoted and sent_id is not null").groupBy("chunk_uid", "sent_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return kept.select("chunk_uid", "sent_id", F.concat(F.array(F.col("sent_id").cast("string")), F.col("keys")).alias("bag"))
