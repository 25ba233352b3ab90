"""Problem 8: token ids of a whole corpus by a public byte-level BPE, within Spark's own expressions.

Texts are cut into words once. Each distinct word is encoded once: an ``aggregate`` folds the merges over its bytes,
lowest rank first, with the ranks in a literal map. The most frequent words, a bounded number, then get their ids in
place from a second literal map; only words that aren't among them go through a join. Both maps are cut into buckets,
since a lookup in one of Spark's maps reads it from its start.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.session import materialize, partitions
from sparkweave.sources.tables import read_table

#: The folder of the tokenizers' files, and the vocabulary.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern of this tokenizer that cuts a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 8192
#: Most words whose ids are put in place from a literal map, and its buckets.
HEAD, HEAD_BUCKETS = 65_536, 65_536
_NONE = 2147483647
_RANKS = "array<map<string,int>>"


@lru_cache(maxsize=4)
def _rank_json(path: str) -> str:
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    with open(path, "rb") as lines:
        for piece, rank in map(bytes.split, lines):
            text = base64.b64decode(piece).decode("latin-1")
            buckets[zlib.crc32(text.encode()) % BUCKETS][text] = int(rank)
    return json.dumps(buckets)


@lru_cache(maxsize=4)
def _piece_json(path: str) -> str:
    with open(path, "rb") as lines:
        pieces = {int(rank): base64.b64decode(piece).decode("latin-1") for piece, rank in map(bytes.split, lines)}
    return json.dumps([pieces.get(i) for i in range(max(pieces) + 1)])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _rank(ranks: Column, piece: Column) -> Column:
    return F.coalesce(F.element_at(F.get(ranks, F.pmod(F.crc32(piece.cast("binary")), F.lit(BUCKETS)).cast("int")), piece), F.lit(_NONE))


def encode_word(word: Column, ranks: Column) -> Column:
    """``array<int>``: the ids of one word. The work grows with the square of the word's bytes."""
    text = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    parts = F.split(text, "")

    def merge(acc: Column, _: Column) -> Column:
        def at(i: Column) -> Column:
            p, r = acc["p"], acc["r"]
            n = F.size(p)

            def joined(m: Column) -> Column:
                left = F.when(i > 1, F.array(_rank(ranks, F.concat(F.get(p, i - 2), m)))).otherwise(F.array().cast("array<int>"))
                right = F.when(i < n - 1, F.array(_rank(ranks, F.concat(m, F.get(p, i + 1))))).otherwise(F.array().cast("array<int>"))
                return F.struct(
                    F.concat(F.slice(p, 1, i - 1), F.array(m), F.slice(p, i + 2, n)).alias("p"),
                    F.concat(F.slice(r, 1, F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, n)).alias("r"),
                )

            return _let(F.concat(F.get(p, i - 1), F.get(p, i)), joined)

        lowest = F.array_min(acc["r"])
        return F.when(F.coalesce(lowest, F.lit(_NONE)) == _NONE, acc).otherwise(_let(F.array_position(acc["r"], lowest).cast("int"), at))

    def folded(p: Column) -> Column:
        pairs = F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, i: _rank(ranks, F.concat(a, F.get(p, i + 1))))
        start = F.struct(p.alias("p"), pairs.alias("r"))
        steps = F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, merge, lambda acc: F.transform(acc["p"], lambda x: _rank(ranks, x)))

    whole = _rank(ranks, text)
    return F.when(whole != _NONE, F.array(whole)).otherwise(_let(parts, folded))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))


def _head_count(words: DataFrame, most: int) -> int:
    """The least number of rows that ``most`` words at most have or exceed, from a histogram of eighths of octaves."""
    step = F.floor(F.log2("n_rows") * 8)
    sizes = {r["step"]: r["n"] for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, least = 0, 0
    for s in sorted(sizes, reverse=True):
        total += sizes[s]
        if total > most:
            least = s + 1
            break
    return math.ceil(2 ** (least / 8) - 1e-9)


def _place(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(HEAD_BUCKETS))


def _head(words: DataFrame, least: int) -> Column:
    """The ids of words with ``least`` rows or more as a literal of maps by bucket."""
    buckets: list[dict[str, list[int]]] = [{} for _ in range(HEAD_BUCKETS)]
    for r in words.filter(F.col("n_rows") >= least).select("word", "ids", _place(F.col("word")).alias("b")).toLocalIterator():
        buckets[r["b"]][r["word"]] = r["ids"]
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,array<int>>>")


def _filled(ids: Column, tail: Column) -> Column:
    """``ids`` with each -1, in order, replaced by the next list of ``tail``."""
    holes = F.filter(F.transform(ids, lambda x, i: F.when(x == -1, i)), lambda i: i.isNotNull())

    def whole(h: Column) -> Column:
        def piece(t: Column, k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(h, k - 1) + 1)
            return F.concat(F.slice(ids, start + 1, F.get(h, k) - start), t)

        last = F.element_at(h, -1)
        return F.concat(F.flatten(F.transform(tail, piece)), F.slice(ids, last + 2, F.greatest(F.size(ids) - last - 1, F.lit(0))))

    return _let(holes, whole)


def token_ids(docs: DataFrame, id_col: str, text_col: str, path: str = f"{TOKENIZERS}/{VOCABULARY}", head: int = HEAD) -> DataFrame:
    """``<id_col>, ids array<int>``, one row for each row of ``docs``, repeated ones too.

    A null and an empty text give an empty list; names of special tokens in a text are ordinary text; a table without
    rows gives none. A null id is kept as it is. Other columns are not looked at. Words beyond the ``head`` most
    frequent ones go through a join; none of them has over 1 / ``head`` of all words, so it needs no salt.
    """
    ranks = F.from_json(F.lit(_rank_json(path)), _RANKS)
    words_col = F.coalesce(words_of(F.col(text_col)), F.array().cast("array<string>"))
    cut = materialize(docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), words_col.alias("_words")), "p8-cut")
    counted = cut.select(F.explode("_words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_rows"))
    # a fixed number: few bytes, but much work for each of them
    counted = counted.repartition(partitions(docs.sparkSession), F.xxhash64("word"))
    words = materialize(counted.select("word", "n_rows", encode_word(F.col("word"), ranks).alias("ids")), "p8-words")
    least = _head_count(words, head)
    known = _head(words, least)
    found = lambda w: F.element_at(F.get(known, _place(w)), w)
    if words.filter(F.col("n_rows") < least).isEmpty():
        return cut.select(F.col("_id").alias(id_col), F.flatten(F.transform("_words", found)).alias("ids"))
    coded = cut.select("_id", "_row", F.flatten(F.transform("_words", lambda w: F.coalesce(found(w), F.array(F.lit(-1))))).alias("ids"), "_words")
    whole = coded.filter(~F.array_contains("ids", -1)).select(F.col("_id").alias(id_col), "ids")
    rest = coded.filter(F.array_contains("ids", -1)).select("_id", "_row", "ids")
    tail = cut.select("_row", F.posexplode("_words").alias("_pos", "word")).join(words.filter(F.col("n_rows") < least).select("word", F.col("ids").alias("_own")), "word")
    listed = tail.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "_own"))).alias("_all"))
    full = rest.join(listed, "_row").select(F.col("_id").alias(id_col), _filled(F.col("ids"), F.col("_all._own")).alias("ids"))
    return whole.unionByName(full)


def decode_ids(df: DataFrame, ids_col: str, out: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """Adds the text of a list of ids: the pieces' bytes put together. An empty list gives an empty text, a null one null."""
    pieces = F.from_json(F.lit(_piece_json(path)), "array<string>")
    text = F.array_join(F.transform(F.col(ids_col), lambda i: F.get(pieces, i)), "")
    return df.withColumn(out, F.decode(F.encode(text, "ISO-8859-1"), "UTF-8"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return token_ids(read_table(spark, sf, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
ORACLE: dict[str, str] = {}
