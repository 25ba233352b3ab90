"""The default annotator, by rules: tokens with part of speech, noun chunks, names, and relation candidates.

It stands in for language models behind the same frames; whatever gives these frames (``Annotator``) can take its place.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.functions.text import lemma_key
from sparkweave.session import partitions

#: Word lists of the default annotator.
PRONOUNS = "it that they those we which who he she i you this these".split()
FUNCTION_WORDS = {
    "DET": "the a an each every some any no both most few four three two one".split(),
    "ADP": "of in on at by with from for to into over under after before between among across without against once as than about within despite outside during near".split(),
    "CONJ": "and or but while when if because so neither nor whereas".split(),
    "VERB": "is was were are be been being has have had do does did not said say says found noted told asked argued wrote held know thinks can could may might will would seemed came went made kept mattered helped turned".split(),
}
ADJECTIVE = "(?:al|ic|ous|ive|ed|ary|able|ish|less|ful|er|est)$"
#: Labels of names and, for relations, which types may stand at either end (none: any).
NER_LABELS = ["Behavior", "City", "Company", "Condition", "Conference", "Country", "Food", "Food Additive", "Hospital", "Organ", "Organization", "People Group", "Person", "Publication", "Research", "Science", "University"]
RE_LABELS = {
    "co_founder": (["PERSON"], ["ORG"]),
    "country_of_origin": (["PERSON", "ORG"], ["LOC", "GPE"]),
    "no_relation": ([], []),
    "parent": (["PERSON"], ["PERSON"]),
    "followed_by": (["PERSON", "ORG"], ["PERSON", "ORG"]),
    "spouse": (["PERSON"], ["PERSON"]),
    "child": (["PERSON"], ["PERSON"]),
    "founder": (["PERSON"], ["ORG"]),
    "headquartered_in": (["ORG"], ["LOC", "GPE", "FAC"]),
    "acquired_by": (["ORG"], ["ORG", "PERSON"]),
    "subsidiary_of": (["ORG"], ["ORG", "PERSON"]),
}
#: Our mapping between the two sets of types, which have no member in common.
TYPES = {"Person": "PERSON", "Company": "ORG", "Organization": "ORG", "Hospital": "ORG", "University": "ORG", "City": "GPE", "Country": "GPE"}
#: Type of entities with another label; it stands only where a relation allows any.
UNTYPED = "-"
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
BLANKS = "[ \t\r\f]+"


def part_of_speech(core: Column, at: Column) -> Column:
    """Of a word without its punctuation, at a place in its sentence."""
    low = F.lower(core)
    out = F.when(core == "", "PUNCT").when(low.isin(PRONOUNS), "PRON")
    for pos, words in FUNCTION_WORDS.items():
        out = out.when(low.isin(words), pos)
    out = out.when(core.rlike(r"^[0-9]"), "NUM").when(core.rlike(r"^\p{Lu}") & (at > 0), "PROPN")
    return out.when(low.rlike(ADJECTIVE), "ADJ").otherwise("NOUN")


def lemma_of(core: Column, pos: Column) -> Column:
    """Lower case; of nouns a regular plural's singular."""
    low = F.lower(core)
    noun = F.when(low.rlike("[^aeiou]ies$"), F.regexp_replace(low, "ies$", "y")).when(low.rlike("[^sui]s$"), F.regexp_replace(low, "s$", "")).otherwise(low)
    return F.when(pos == "NOUN", noun).otherwise(low)


def tokens(chunks: DataFrame) -> DataFrame:
    """``doc_seq, chunk_uid, sent_id, tok_i, at, text, pos, lemma, key`` of ``doc_seq, chunk_uid, text``.

    A line is a sentence, a token a stretch without blanks; ``tok_i`` counts over the chunk. Null texts give none.
    """
    words = F.flatten(
        F.transform(F.split("text", "\n"), lambda line, i: F.transform(F.filter(F.split(line, BLANKS), lambda w: w != ""), lambda w, k: F.struct(i.alias("sent_id"), k.alias("at"), w.alias("word"))))
    )
    # by a hash of the id: by the id itself an exchange that is there already, and merged by its few bytes, would be taken
    spread = chunks.filter("text is not null").select("doc_seq", "chunk_uid", "text").repartition(partitions(chunks.sparkSession), F.xxhash64("chunk_uid"))
    each = spread.select("doc_seq", "chunk_uid", F.posexplode(words).alias("tok_i", "w"))
    each = each.select("doc_seq", "chunk_uid", "w.sent_id", "tok_i", "w.at", F.regexp_replace("w.word", EDGES, "").alias("text"))
    each = each.withColumn("pos", part_of_speech(F.col("text"), F.col("at"))).withColumn("lemma", lemma_of(F.col("text"), F.col("pos")))
    return each.withColumn("key", lemma_key(F.col("pos"), F.col("lemma")))


def _runs(marked: DataFrame) -> DataFrame:
    """Runs of kept tokens in a row: islands of equal difference between place and rank."""
    ranked = marked.selectExpr("*", "tok_i - row_number() over (partition by doc_seq, chunk_uid, sent_id order by tok_i) as island")
    return ranked.groupBy("doc_seq", "chunk_uid", "sent_id", "island").agg(F.array_sort(F.collect_list(F.struct("tok_i", "pos", "key", "text"))).alias("t"))


_SPAN = ["doc_seq", "chunk_uid", "sent_id"]


def noun_chunks(toks: DataFrame) -> DataFrame:
    """``span_start, span_end, key, text, label``: greatest runs of adjectives, figures and nouns that end in a noun,
    and single pronouns, labelled NP."""
    runs = _runs(toks.filter(F.col("pos").isin("ADJ", "NOUN", "PROPN", "NUM")))
    last = F.array_max(F.transform("t", lambda x, i: F.when(x["pos"].isin("NOUN", "PROPN"), i)))
    kept = runs.withColumn("t", F.slice("t", 1, last + 1)).filter("t is not null and size(t) > 0")
    single = toks.filter("pos = 'PRON'").select(*_SPAN, F.array(F.struct("tok_i", "pos", "key", "text")).alias("t"))
    return _spans(kept.select(*_SPAN, "t").unionByName(single), F.lit("NP"))


def _spans(runs: DataFrame, label: Column) -> DataFrame:
    return runs.select(
        *_SPAN, F.col("t")[0]["tok_i"].alias("span_start"), (F.element_at("t", -1)["tok_i"] + 1).alias("span_end"),
        F.array_join("t.key", " ").alias("key"), F.array_join("t.text", " ").alias("text"), label.alias("label"),
    )


def gazetteer(mentions: DataFrame) -> DataFrame:
    """``name, label``: of each name in lower case its most frequent label among the known ones, ties by label."""
    seen = mentions.filter(F.col("label").isin(NER_LABELS) & F.col("text").isNotNull()).groupBy(F.lower("text").alias("name"), "label").agg(F.count(F.lit(1)).alias("n"))
    return seen.groupBy("name").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))


def named_entities(toks: DataFrame, names: DataFrame) -> DataFrame:
    """Greatest runs of proper nouns that the gazetteer knows, with its label."""
    found = _spans(_runs(toks.filter("pos = 'PROPN'")), F.lit(None).cast("string")).drop("label")
    return found.withColumn("name", F.lower("text")).join(names, "name").drop("name")


def relation_candidates(ents: DataFrame) -> DataFrame:
    """``chunk_uid, sent_id, h_start, h_end, t_start, t_end, label, score``: ordered pairs of a sentence's entities that
    the types of a relation allow, with a score that falls with their distance, of half or more."""
    types = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    typed = ents.withColumn("type", F.coalesce(F.element_at(types, F.col("label")), F.lit(UNTYPED)))
    every = [*dict.fromkeys(TYPES.values()), UNTYPED]
    rows = [(label, h, t) for label, (heads, tails) in RE_LABELS.items() for h in heads or every for t in tails or every]
    allowed = ents.sparkSession.createDataFrame(rows, "label string, h_type string, t_type string")
    h = typed.select("chunk_uid", "sent_id", F.col("span_start").alias("h_start"), F.col("span_end").alias("h_end"), F.col("type").alias("h_type"))
    t = typed.select("chunk_uid", "sent_id", F.col("span_start").alias("t_start"), F.col("span_end").alias("t_end"), F.col("type").alias("t_type"))
    pairs = h.join(t, ["chunk_uid", "sent_id"]).filter("h_start <> t_start or h_end <> t_end").join(F.broadcast(allowed), ["h_type", "t_type"])
    gap = F.greatest(F.abs(F.col("t_start") - F.col("h_start")), F.lit(1))
    score = F.bround(F.lit(1.0) / (1 + gap / 10.0), 3)
    return pairs.withColumn("score", score).filter("score >= 0.5").select("chunk_uid", "sent_id", "h_start", "h_end", "t_start", "t_end", "label", "score")


#: Labels that pairs of noun chunks may have for the sake of completeness, but that are never kept.
STOP_RELATIONS = ["has part"]
MIN_SCORE = 0.5


def pairwise_relations(chunked: DataFrame, names: DataFrame) -> DataFrame:
    """``chunk_uid, sent_id, h_start, h_end, t_start, t_end, label, score``: of each two noun chunks of a sentence, the
    earlier one first, the relation inferred for them, if its score is a half or more and it isn't "has part".

    Inferred by rules in place of a model: "has part" where one chunk's words are among the other's; else the first
    relation that the chunks' types by the gazetteer ``names`` allow, else the one of any types. The score falls with
    the distance. Ties don't occur, as a pair has one relation; repeated spans count once.
    """
    types = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    once = chunked.select("chunk_uid", "sent_id", "span_start", "span_end", "key", F.lower("text").alias("name")).dropDuplicates(["chunk_uid", "span_start", "span_end"])
    typed = once.join(names, "name", "left").withColumn("type", F.coalesce(F.element_at(types, F.col("label")), F.lit(UNTYPED)))
    side = lambda c: typed.select("chunk_uid", "sent_id", *[F.col(x).alias(f"{c}_{x}") for x in ("span_start", "span_end", "key", "type")])
    pairs = side("h").join(side("t"), ["chunk_uid", "sent_id"]).filter("(h_span_start, h_span_end) < (t_span_start, t_span_end)")
    allowed = F.lit(None).cast("string")
    for label, (heads, tails) in sorted(RE_LABELS.items(), reverse=True):
        if heads:
            allowed = F.when(F.col("h_type").isin(heads) & F.col("t_type").isin(tails), label).otherwise(allowed)
    within = lambda a, b: F.size(F.array_except(F.split(a, " "), F.split(b, " "))) == 0
    label = F.when(within("h_key", "t_key") | within("t_key", "h_key"), "has part").otherwise(F.coalesce(allowed, F.lit("no_relation")))
    gap = F.greatest(F.col("t_span_start") - F.col("h_span_end"), F.lit(1))
    scored = pairs.withColumn("label", label).withColumn("score", F.bround(F.lit(1.0) / (1 + gap / 10.0), 3))
    kept = scored.filter((F.col("score") >= MIN_SCORE) & ~F.col("label").isin(STOP_RELATIONS))
    return kept.select("chunk_uid", "sent_id", F.col("h_span_start").alias("h_start"), F.col("h_span_end").alias("h_end"), F.col("t_span_start").alias("t_start"), F.col("t_span_end").alias("t_end"), "label", "score")


class Annotator(Protocol):
    """What the pipeline asks of an annotator; chunks are ``doc_seq, chunk_uid, text``, and frames are those of this module."""

    def tokens(self, chunks: DataFrame) -> DataFrame: ...

    def noun_chunks(self, toks: DataFrame) -> DataFrame: ...

    def named_entities(self, toks: DataFrame) -> DataFrame: ...

    def relations(self, ents: DataFrame) -> DataFrame: ...


@dataclass
class RuleAnnotator:
    """The default: rules, and names from a gazetteer (``name, label``); without one no names are found."""

    names: DataFrame | None = None

    def tokens(self, chunks: DataFrame) -> DataFrame:
        return tokens(chunks)

    def noun_chunks(self, toks: DataFrame) -> DataFrame:
        return noun_chunks(toks)

    def named_entities(self, toks: DataFrame) -> DataFrame:
        names = self.names if self.names is not None else toks.sparkSession.createDataFrame([], "name string, label string")
        return named_entities(toks, names)

    def relations(self, ents: DataFrame) -> DataFrame:
        return relation_candidates(ents)
