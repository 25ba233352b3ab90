"""Problem 2: variant spellings of names, by a trie join.

Names are read as persons or bodies and sharded into tries, which a Levenshtein automaton searches for neighbours within
one edit: whole names, and a person's given and family names by themselves, so that longer names may have an edit in each
word. Other orders of the same words are then looked up by their sorted words, and given names, initials and
designations are checked.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators.components import connected_components
from sparkweave.session import materialize
from sparkweave.sources.tables import read_table

LABELS = ("Person", "Company", "Organization", "University", "Hospital")
#: A given name that stands with so many family names is one of its own, not a slip in another.
ESTABLISHED = 3
#: Names of a shard that one task holds as a trie.
TRIE = 20_000
MOST_SHARED = 8

#: Short forms of given names in common use.
NICKNAMES = {
    "abby": "abigail", "al": "albert alan", "alex": "alexander alexandra", "andy": "andrew", "becky": "rebecca", "ben": "benjamin", "beppe": "giuseppe", "bert": "albert robert",
    "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "charlie": "charles", "chris": "christopher christine",
    "chuck": "charles", "dan": "daniel", "danny": "daniel", "dave": "david", "dick": "richard", "dot": "dorothy", "dottie": "dorothy", "ed": "edward", "eddie": "edward",
    "fred": "frederick", "freddie": "frederick", "gabe": "gabriel", "greg": "gregory", "hannes": "johannes", "hans": "johannes", "harry": "henry harold", "jack": "john",
    "jen": "jennifer", "jenny": "jennifer", "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "jon": "jonathan", "kate": "katherine", "kathy": "katherine",
    "katie": "katherine", "ken": "kenneth", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "liz": "elizabeth", "lizzie": "elizabeth", "maggie": "margaret",
    "matt": "matthew", "meg": "margaret", "mick": "michael", "mike": "michael", "molly": "mary", "nat": "nathaniel", "ned": "edward", "nick": "nicholas", "paco": "francisco",
    "pancho": "francisco", "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret", "pepe": "jose", "pete": "peter", "phil": "philip", "pippa": "philippa", "ray": "raymond",
    "rick": "richard", "rob": "robert", "robbie": "robert", "ron": "ronald", "sam": "samuel samantha", "sasha": "alexander alexandra", "steve": "stephen", "sue": "susan", "susie": "susan",
    "ted": "edward theodore", "teddy": "edward theodore", "theo": "theodore", "tilly": "matilda", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "tony": "anthony",
    "trish": "patricia", "vicky": "victoria", "will": "william", "willy": "william",
}
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame dipl ing phd md".split())
#: Short forms of words in the names of bodies, and words that name a body's kind.
ABBREVIATIONS = {
    "univ": "university", "tech": "technical", "appl": "applied", "nutr": "nutrition", "mem": "memorial", "hosp": "hospital", "gen": "general", "med": "medical", "ctr": "center",
    "centre": "center", "assoc": "association", "assn": "association", "cncl": "council", "coun": "council", "found": "foundation", "fdn": "foundation", "soc": "society", "inst": "institute",
    "res": "research", "intl": "international", "natl": "national", "bros": "brothers", "co": "company", "corp": "corporation", "diag": "diagnostics", "biosci": "biosciences", "ltd": "limited",
    "inc": "incorporated", "child": "childrens", "dept": "department", "hlth": "health", "acad": "academy", "coll": "college", "ptnrs": "partners",
}
LEGAL = frozenset("limited incorporated gmbh company corporation llc plc ag sa".split())
JOINING = frozenset("of on for the and".split())
BODY = frozenset(
    "university technical applied nutrition memorial hospital general medical center county childrens association dietary nurses council rural health foundation society institute memory research "
    "international national brothers milling diagnostics biosciences foods food sons partners college academy clinic trust works department ageing".split()
) | LEGAL
_FOLD = str.maketrans({"ø": "o", "æ": "ae", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "œ": "oe", "ı": "i"})


def plain(text: str) -> str:
    """Lower case, without accents, apostrophes and hyphens; other punctuation but the comma as spaces."""
    low = unicodedata.normalize("NFKD", text.lower()).translate(_FOLD)
    low = "".join(ch for ch in low if not unicodedata.combining(ch))
    low = re.sub(r"['’`´‘-]|(?<=\w)[‐‑](?=\w)", "", low).replace("&", " and ")
    return " ".join(re.sub(r"[^\w,]|_", " ", low).replace(",", " , ").split())


def forms(text: str, body: bool | None = None) -> list[tuple[str, str, str, str, list[str]]]:
    """The readings of a name: kind, space, body, given name, and further keys ``space<tab>body``.

    ``body`` tells whether it is known to be a body's or a person's; else the words decide. Kinds are O for a body, A for one with its kind as an acronym, P for a person with a given name, I for one with an
    initial and S for a family name alone. Keys are compared within their space only.
    """
    words = plain(text).split()
    comma = "," in words
    words = [w for w in words if w != ","]
    if words and words[0] == "the":
        words = words[1:]
    if not words:
        return []
    full = [ABBREVIATIONS.get(w, w) for w in words]
    if body:
        full = [_kind_word(w) for w in full]
    if "u" in full and len(full) > 1 and (full[-1] == "u" and not comma or any(w in BODY for w in full) or full[:2] == ["u", "of"]):
        full = ["university" if w == "u" else w for w in full]
    raw = [w for w in re.split(r"[\s,]+", text) if w]
    acronym = body is not False and len(raw) == 2 and len(words) == 2 and re.fullmatch(r"[A-Z]{3,5}", raw[1]) and not raw[0].isupper()
    if any(w in BODY for w in full) if body is None else body and not (acronym and not any(w in BODY for w in full)):
        kind = [w for w in full if w in BODY]
        core = " ".join(sorted(w for w in full if w not in BODY and w not in JOINING))
        if not core:
            core, kind = " ".join(kind), []
        kept = sorted(set(kind) - LEGAL) or sorted(set(kind))
        first = "".join(w[0] for w in full if w in BODY or w == "and" and full[full.index("and") + 1 :][:1] == ["partners"])
        return [("O", "O:" + " ".join(kept), core, "", [f"A:{first}\t{core}"] if len(first) > 2 else [])]
    if acronym:
        return [("A", "A:" + words[1], words[0], "", [])]
    words = [w for w in words if w not in TITLES] or words
    single = [w for w in words if len(w) == 1]
    long = [w for w in words if len(w) > 1]
    if len(long) == 1:
        return [("I", "I:" + single[0], long[0], "", [])] if single else [("S", "S", long[0], "", [])]
    if not long:
        return [("S", "S", " ".join(words), "", [])]
    return [_person(long[-1] if comma else long[0], " ".join(long[:-1] if comma else long[1:])), *([] if comma or len(long) != 2 else [_person(long[1], long[0], turned=True)])]


def _person(given: str, family: str, turned: bool = False) -> tuple[str, str, str, str, list[str]]:
    """A short form of one given name is read as this; one of several stands for itself, with each of them as a key.

    Names of three words or more have their sorted words as a key as well.
    """
    formal = NICKNAMES.get(given, given).split()
    own = formal[0] if len(formal) == 1 else given
    words = [own, *family.split()]
    order = [f"W\t{' '.join(sorted(words))}"] if len(words) > 2 else []
    return ("T" if turned else "P", "P", f"{own} {family}", given, [f"P\t{g} {family}" for g in formal if g != own] + [f"I:{g[0]}\t{family}" for g in formal] + [f"S\t{family}"] + order)


_FORMS = "text string, kind string, space string, body string, given string, more array<string>"


def _form_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(t, *f) for t, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in forms(t, body)]
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.string()] * 5 + [pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["text", "kind", "space", "body", "given", "more"])


class Trie:
    """A trie of words with a search for those within one edit, a swap of neighbours counting as one."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str) -> None:
        node = self.root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = word

    def near(self, word: str) -> set[str]:
        """The automaton's states are a node, a place in the word, and whether the edit is spent."""
        n, found, states = len(word), set(), [(self.root, 0, False)]
        while states:
            node, i, spent = states.pop()
            if i == n:
                if "" in node:
                    found.add(node[""])
                if not spent:
                    found.update(child[""] for ch, child in node.items() if ch and "" in child)
                continue
            if (child := node.get(word[i])) is not None:
                states.append((child, i + 1, spent))
            if not spent:
                states.append((node, i + 1, True))
                for ch, child in node.items():
                    if ch:
                        states.append((child, i, True))
                        if ch != word[i]:
                            states.append((child, i + 1, True))
                if i + 1 < n and (child := node.get(word[i + 1])) and (child := child.get(word[i])):
                    states.append((child, i + 2, True))
        found.discard(word)
        return found


#: Letters from which a word of a body's name may be a slip in a word of its kind.
LONG_KIND = 7
_KINDS = Trie()
for _word in BODY:
    _KINDS.add(_word)


@lru_cache(maxsize=1 << 14)
def _kind_word(word: str) -> str:
    """A word that names a body's kind for one that is an edit from it alone."""
    if word in BODY or len(word) < LONG_KIND:
        return word
    near = [w for w in _KINDS.near(word) if len(w) >= LONG_KIND]
    return near[0] if len(near) == 1 else word


def _search(rows: pa.Table) -> pa.Table:
    """Of one shard, neighbours of all its searching words among those it holds; words are turned in shards of endings."""
    trie, space = Trie(), rows["space"][0].as_py()
    turned = rows["side"][0].as_py() == "R"
    order = (lambda w: w[::-1]) if turned else (lambda w: w)
    for word, held in zip(rows["body"].to_pylist(), rows["held"].to_pylist()):
        if held:
            trie.add(order(word))
    pairs = {(min(w, order(v)), max(w, order(v))) for w, asks in zip(rows["body"].to_pylist(), rows["asks"].to_pylist()) if asks for v in trie.near(order(w))}
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.table({"space": pa.array([space] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})


def trie_join(words: DataFrame) -> DataFrame:
    """``space, a, b``: the pairs a < b of a space's words (``space, body``) within one edit of each other.

    Of two such words of m letters or more, one of the first and the last (m - 1) / 2 letters are the same, so words
    are sharded by both. A shard of more than ``TRIE`` words is cut, those it holds and those that search alike, and each
    cut of the one meets each of the other, so that no task gets more than twice ``TRIE``. Words of under three letters
    and null words have no neighbours.
    """
    w = words.select("space", "body").filter("body is not null and length(body) >= 3").distinct()
    shared = lambda m: F.least(F.floor((m - 1) / 2), F.lit(MOST_SHARED)).cast("int")
    n = F.length("body")
    sizes = F.array_distinct(F.array(F.greatest(shared(n), F.lit(1)), F.greatest(shared(n - 1), F.lit(1))))
    keyed = w.withColumn("q", F.explode(sizes)).withColumn("side", F.explode(F.array(F.lit("L"), F.lit("R"))))
    keyed = keyed.withColumn("part", F.when(F.col("side") == "L", F.expr("left(body, q)")).otherwise(F.expr("right(body, q)")))
    shard = ["space", "side", "q", "part"]
    counts = keyed.groupBy(*shard).agg(F.ceil(F.count(F.lit(1)) / TRIE).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("body"), F.col("cuts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    cut = keyed.join(counts, shard).withColumn("own", own)
    held = cut.select(*shard, F.col("own").alias("cut"), every.alias("askers"), "body", F.lit(True).alias("held"), (F.col("cuts") == 1).alias("asks"))
    asks = cut.filter("cuts > 1").select(*shard, every.alias("cut"), F.col("own").alias("askers"), "body", F.lit(False).alias("held"), F.lit(True).alias("asks"))
    # a fixed number of partitions: few bytes, but much work for each of them
    placed = held.unionByName(asks).repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), *shard, "cut", "askers")
    return placed.groupBy(*shard, "cut", "askers").applyInArrow(_search, "space string, a string, b string").distinct()


def _key(space: str = "space", body: str = "body"):
    return F.concat_ws("\t", F.col(space), F.col(body))


def _edit_in_both(people: DataFrame, near: DataFrame, established: DataFrame) -> DataFrame:
    """``space, a, b``: persons whose given and family names are each one edit apart, unless both given names are established."""
    who = people.filter("kind in ('P', 'T')").select(F.col("body").alias("a"), F.expr("substring_index(body, ' ', 1)").alias("ga"), F.expr("substr(body, instr(body, ' ') + 1)").alias("fa")).distinct()
    other = who.select(F.col("a").alias("b"), F.col("ga").alias("gb"), F.col("fa").alias("fb"))
    both_ways = lambda space, x, y: near.filter(F.col("space") == space).select(F.explode(F.array(F.struct(F.col("a").alias(x), F.col("b").alias(y)), F.struct(F.col("b").alias(x), F.col("a").alias(y)))).alias("p")).select("p.*")
    met = who.join(both_ways("F", "fa", "fb"), "fa").join(both_ways("G", "ga", "gb"), "ga").join(other, ["gb", "fb"]).filter("a < b")
    known = lambda g, n: established.select(F.col("g").alias(g), F.col("families").alias(n))
    met = met.join(known("ga", "na"), "ga", "left").join(known("gb", "nb"), "gb", "left").filter(f"coalesce(na, 0) < {ESTABLISHED} or coalesce(nb, 0) < {ESTABLISHED}")
    return met.select(F.lit("P").alias("space"), "a", "b")


def name_groups(names: DataFrame, column: str, label: str | None = None) -> DataFrame:
    """``text, name_id``: of each distinct non-null name in ``column`` the group of spellings of one person or body.

    With ``label`` a name is a person's if more of its rows have the label Person than another one; without, and in a
    tie, its words decide. Names without a letter or figure are left out; an empty table gives no rows. An initial, a
    lone family name or a short form of several given names joins a person only if it fits one alone, so that relatives
    stay apart.
    """
    kind_of = F.when(F.col(label) == "Person", -1).when(F.col(label).isNotNull(), 1).otherwise(0) if label else F.lit(0)
    votes = names.select(F.col(column).alias("text"), kind_of.alias("vote")).filter("text is not null").groupBy("text").agg(F.sum("vote").alias("vote"))
    texts = votes.select("text", F.when(F.col("vote") != 0, F.col("vote") > 0).alias("body"))
    read = materialize(texts.mapInArrow(_form_batches, _FORMS), "p2-forms")
    main = read.filter("kind <> 'T'")
    # of two words either may be the given name: the one that stands first in more of the names it is in
    people = read.filter("kind in ('P', 'T')").withColumn("two", F.expr("count(if(kind = 'T', 1, null)) over (partition by text)"))
    place = people.filter("two > 0").groupBy("given").agg(F.avg(F.when(F.col("kind") == "P", 1.0).otherwise(0.0)).alias("first"))
    people = people.join(place, "given", "left").withColumn("first", F.when(F.col("given").isin(*NICKNAMES), 1.0).otherwise(F.coalesce("first", F.lit(1.0))))
    people = people.withColumn("best", F.expr("max(struct(first, if(kind = 'P', 1, 0))) over (partition by text)")).filter("best.first = first and best.col2 = if(kind = 'P', 1, 0)")
    others = main.filter("kind <> 'P'")
    chosen = materialize(people.select(*read.columns).unionByName(others), "p2-chosen")
    aliases = chosen.select("text", "kind", _key().alias("node"), F.explode("more").alias("alias"))
    spaces = chosen.select("space", "body").unionByName(aliases.select(F.expr("split(alias, '\t')[0]").alias("space"), F.expr("split(alias, '\t')[1]").alias("body")))
    # given and family names by themselves
    given, family = F.expr("substring_index(body, ' ', 1)"), F.expr("substr(body, instr(body, ' ') + 1)")
    in_two = spaces.filter("space = 'P'").select(F.explode(F.array(F.struct(F.lit("G").alias("space"), given.alias("body")), F.struct(F.lit("F").alias("space"), family.alias("body")))).alias("w")).select("w.*")
    spaces = spaces.unionByName(in_two)
    near = materialize(trie_join(spaces), "p2-near")

    names_of = chosen.filter("kind in ('P', 'T')").select(F.expr("substring_index(body, ' ', 1)").alias("g"), F.expr("substring_index(body, ' ', -1)").alias("f"))
    established = names_of.groupBy("g").agg(F.countDistinct("f").alias("families"))
    ga, gb = F.expr("substring_index(a, ' ', 1)").alias("ga"), F.expr("substring_index(b, ' ', 1)").alias("gb")
    pairs = near.filter("space = 'P'").select("space", "a", "b", ga, gb)
    pairs = pairs.join(established.select(F.col("g").alias("ga"), F.col("families").alias("fa")), "ga", "left").join(established.select(F.col("g").alias("gb"), F.col("families").alias("fb")), "gb", "left")
    pairs = pairs.filter(f"ga = gb or coalesce(fa, 0) < {ESTABLISHED} or coalesce(fb, 0) < {ESTABLISHED}")
    bodies = near.filter("space like 'O:%' or space = 'W'")
    edges = pairs.select("space", "a", "b").unionByName(bodies).unionByName(_edit_in_both(chosen, near, established)).select(F.concat_ws("\t", "space", "a").alias("a"), F.concat_ws("\t", "space", "b").alias("b"))
    # a short form of several given names is linked to the one that stands with the family name, if there is one alone:
    # as it is spelled, else within an edit
    nodes = chosen.filter("kind in ('P', 'T', 'O', 'A')").select(_key().alias("node")).distinct()
    choice = aliases.filter("alias like 'P\t%' and kind in ('P', 'T')").select("node", "alias").distinct()
    like = near.filter("space = 'P'").select(F.concat_ws("\t", "space", "a").alias("x"), F.concat_ws("\t", "space", "b").alias("y"))
    like = like.unionByName(like.select(F.col("y").alias("x"), F.col("x").alias("y")))
    met = nodes.withColumn("far", F.lit(0)).unionByName(like.join(nodes.withColumnRenamed("node", "y"), "y", "left_semi").select(F.col("x").alias("node"), F.lit(1).alias("far")))
    fitting = choice.join(met.groupBy("node").agg(F.min("far").alias("far")).withColumnRenamed("node", "alias"), "alias").groupBy("node", "far").agg(F.min("alias").alias("alias"), F.count(F.lit(1)).alias("n"))
    one = fitting.groupBy("node").agg(F.min_by(F.struct("alias", "n"), "far").alias("m")).filter("m.n = 1")
    edges = edges.unionByName(one.select(F.col("node").alias("a"), F.col("m.alias").alias("b")))
    # names of the same words in another order meet at their sorted words
    edges = edges.unionByName(aliases.filter("alias like 'W\t%' and kind in ('P', 'T')").select(F.col("node").alias("a"), F.col("alias").alias("b")))
    # a body with its kind as an acronym is linked to those whose words have it, the rest of the name within an edit
    acronyms = nodes.filter("node like 'A:%'")
    met = near.filter("space like 'A:%'").select(F.explode(F.array(F.struct(F.concat_ws("\t", "space", "a").alias("a"), F.concat_ws("\t", "space", "b").alias("b")), F.struct(F.concat_ws("\t", "space", "b").alias("a"), F.concat_ws("\t", "space", "a").alias("b")))).alias("p")).select("p.*")
    met = met.join(acronyms.withColumnRenamed("node", "a"), "a", "left_semi")
    reached = acronyms.unionByName(met.select(F.col("b").alias("node"))).distinct()
    edges = edges.unionByName(met.select("a", "b")).unionByName(aliases.join(reached.withColumnRenamed("node", "alias"), "alias", "left_semi").select(F.col("node").alias("a"), F.col("alias").alias("b")))
    groups = materialize(connected_components(nodes, edges), "p2-groups")

    # initials and lone family names: by the same key, else by one within an edit, if all that fit are one person
    fits = aliases.filter("kind in ('P', 'T') and (alias like 'S\t%' or alias like 'I:%')").join(groups, "node").select("alias", "component").distinct()
    short = chosen.filter("kind in ('I', 'S')").select(_key().alias("node")).distinct()
    both = near.filter("space = 'S' or space like 'I:%'").select(F.concat_ws("\t", "space", "a").alias("x"), F.concat_ws("\t", "space", "b").alias("y"))
    steps = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).withColumn("far", F.lit(1)).unionByName(short.select(F.col("node").alias("x"), F.col("node").alias("y"), F.lit(0).alias("far")))
    tried = short.join(steps, short["node"] == steps["x"]).join(fits, F.col("y") == F.col("alias")).groupBy("node", "far").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    best = tried.groupBy("node").agg(F.min_by(F.struct("least", "most"), "far").alias("m"))
    joined = materialize(best.filter("m.least = m.most").select("node", F.col("m.least").alias("component")), "p2-short")
    alone = short.join(joined, "node", "left_anti")
    among = both.join(alone.select(F.col("node").alias("x")), "x", "left_semi").join(alone.select(F.col("node").alias("y")), "y", "left_semi").select(F.col("x").alias("a"), F.col("y").alias("b"))
    ids = groups.unionByName(joined).unionByName(connected_components(alone, among))
    return chosen.select("text", _key().alias("node")).join(ids, "node").select("text", F.col("component").alias("name_id"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "entities").filter(F.col("label").isin(*LABELS)).select("text", "label")


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return name_groups(_names(spark, sf), "text", "label")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    groups = materialize(name_groups(_names(spark, sf), "text", "label"), "p2-result")
    a, b = groups.withColumnRenamed("text", "text_a"), groups.withColumnRenamed("text", "text_b")
    return a.join(b, "name_id").filter("text_a < text_b").select("text_a", "text_b")


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
ORACLE: dict[str, str] = {}
