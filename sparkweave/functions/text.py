"""Scalar text functions as Column expressions: scrubbing, lemma keys and label normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python strips it; the notation is read alike by Java and RE2.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _ascii(ch: str) -> str:
    return unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()


_FOLDED = {chr(c): _ascii(chr(c)) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000}
#: For SQL, which has no decomposition either: letters that decompose to one ASCII letter, as a pair of strings, and those that decompose to several.
ONE_FROM = "".join(c for c, a in _FOLDED.items() if len(a) == 1)
ONE_TO = "".join(a for a in _FOLDED.values() if len(a) == 1)
MANY = {c: a for c, a in _FOLDED.items() if len(a) > 1}


def strip(text: Column) -> Column:
    """The text without white space at its ends, of any kind Unicode has."""
    return F.regexp_replace(F.regexp_replace(text, f"^{WHITE}+", ""), f"{WHITE}+$", "")


_QUOTES = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "`": "'", "â": "'", "…": "...", "–": "-"})


def scrubbed(text: str | None) -> str | None:
    """Aggressive clean-up: lines stripped and joined by a space, quotes, ellipses and dashes folded, and ASCII kept only.

    As in the reference a circumflexed a becomes an apostrophe, an em dash disappears and an empty line leaves two spaces.
    """
    if text is None:
        return None
    flat = " ".join(line.strip() for line in text.split("\n")).strip().translate(_QUOTES)
    return flat if flat.isascii() else unicodedata.normalize("NFKD", flat).encode("ascii", "ignore").decode()


def scrub(text: Column) -> Column:
    """``scrubbed`` of a text. Spark has no compatibility decomposition, and tables of it as expressions took forty times
    as long as Arrow batches do. Null gives null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(scrubbed, na_action="ignore")

    return run(text)


def scrub_all(texts: Column) -> Column:
    """``scrubbed`` of each member of an array."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: [scrubbed(t) for t in x], na_action="ignore")

    return run(texts)


def lemma_key(pos: Column, lemma: Column) -> Column:
    """``pos.lemma`` in lower case."""
    return F.concat_ws(".", pos, F.lower(strip(lemma)))


def relation_label(label: Column) -> Column:
    """A relation's label in upper case with underscores."""
    return F.upper(F.replace(F.trim(label), F.lit(" "), F.lit("_")))
