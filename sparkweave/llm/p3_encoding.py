"""Problem 3: garbled text from a wrong decoding, found and restored by round trips.

A stretch is encoded again in each legacy encoding and strictly decoded as the intended one; a result is taken when a
garbling cost drops, and the steps are repeated for nested layers. What stays costly is garbled beyond repair.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.lines import chunk_rows

#: Encodings under which UTF-8 may have been read, and pairs (read as, meant as) of one-byte encodings.
LEGACY = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-5", "iso8859-9", "iso8859-15", "cp437", "cp850", "cp852", "cp866", "mac_roman", "mac_cyrillic", "koi8-r", "gbk", "big5", "shift_jis", "euc_kr")
WORD_SWAPS = (("cp1251", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1250", "cp1252"), ("koi8-r", "cp1252"))
LINE_SWAPS = (("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("iso8859-5", "cp1251"), ("cp1251", "iso8859-5"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("mac_roman", "cp1251"), ("cp850", "cp1251"), ("cp437", "cp1251"), ("koi8-r", "cp866"), ("cp866", "koi8-r"))
LAYERS = 4
#: Share of each letter in Russian text, in per mille.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 1, 1)))
_HARD = set("�")
_WORDS = re.compile(r"([ \t\r\f\v]+)")
_FINE_SYMBOLS = set("·›»«—–’‘“”„‚…©®™°µ€£§×÷±²³¹½¼¾¡¿ªº•†‡‰‹ ′″№→←↑↓⁻﻿​‌‍")
_OPEN = set("“„‘«(‚")


def _bytes(text: str, encoding: str) -> bytes | None:
    """The text's bytes; code points that a Windows code page doesn't have stand for themselves, as lenient decoders do."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if not encoding.startswith("cp125"):
            return None
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) < 0xA0:
                return None
            out.append(ord(ch))
    return bytes(out)


def _decoded(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def _kind(ch: str) -> str:
    if ch < "\x80":
        return "a" if ch.isalpha() else "."
    o = ord(ch)
    if 0x400 <= o < 0x530:
        return "c"
    if ch in "ªºµ":
        return "s"
    if o < 0x250 and ch.isalpha():
        return "l"
    if ch.isalpha():
        return "g" if 0x370 <= o < 0x400 else "o"
    return "s"


def cost(word: str) -> float:
    """How much a word looks garbled; 0 for ordinary words of any script. 2 or more is firm evidence."""
    total = 0.0
    kinds = [_kind(ch) for ch in word]
    run = 0
    for i, (ch, k) in enumerate(zip(word, kinds)):
        before, after = kinds[i - 1] if i else " ", kinds[i + 1] if i + 1 < len(word) else " "
        o = ord(ch)
        run = run + 1 if k == "l" else 0
        if ch in _HARD:
            total += 3
        elif 0x80 <= o < 0xA0:
            total += 2
        elif 0x2500 <= o < 0x25A0:
            total += 2 if before in "alcs" or after in "alcs" else 1
        elif k == "s":
            if i and word[i - 1] in "ÂÃâÅÄĂ" or before == "c" and ch in "·°©®±µ»§" or ch == "\xa0" and i and word[i - 1] in "ВГ" and (i < 2 or kinds[i - 2] != "c"):
                total += 2
            if ch not in _FINE_SYMBOLS:
                total += 1 if before in "alcg" or after in "alcg" else 0.3 if unicodedata.category(ch) in ("Sm", "Sc", "Sk") else 0
            elif before in "lg" and ch not in "’”»›–—…“‘™®°·\xa0" or before in "lg" and after in "al" and ch not in "’–—·\xa0":
                total += 2
            elif before in "alc" and after in "alc" and ch not in "’–—·‑‘\xa0":
                total += 1.5
            elif ch in _OPEN and before in "alc":
                total += 0.7
            elif before == "s" and word[i - 1] not in "’”»›“‘—–…,\xa0" and word[i - 1] != ch and ch not in "”’»\xa0" and " " > word[i - 1]:
                total += 1
        elif k == "c":
            if before in "al" or after in "al":
                total += 2
            if not ("а" <= ch <= "я" or "А" <= ch <= "Я" or ch in "ёЁ"):
                total += 1
            if before == "c" and ch.isupper() and word[i - 1].islower():
                total += 1
        elif k == "g":
            total += 1 if before in "alcs" or after in "alcs" else 0
        elif k == "l":
            if ch.isupper() and before in "al" and (word[i - 1].islower() or word[i + 1 : i + 2].islower()):
                total += 1
            if run >= 3:
                total += 1
        elif k == "o":
            total += 1.5 if before in "al" or after in "al" else 0
    return total


def russian(text: str) -> float:
    """The mean share, in per mille, of the text's Cyrillic letters in Russian; 0 without any."""
    low = [RUSSIAN.get(ch, -20) for ch in text.lower() if "Ѐ" <= ch < "԰"]
    return sum(low) / len(low) if low else 0.0


def _plausible(text: str) -> bool:
    """One or two letters of another script are too little evidence: bytes of any two or three letters may decode to them."""
    return len(text) > 2 or all(_kind(ch) not in "og" for ch in text)


def _fold(word: str) -> str:
    """The word with the garbling of its layers undone, as far as the cost drops."""
    for _ in range(LAYERS):
        now = cost(word)
        best, least = None, now
        for legacy in LEGACY:
            data = _bytes(word, legacy)
            text = data and _decoded(data, "utf-8")
            if text and text != word and _plausible(text) and (c := cost(text) - 0.5 * (now > 0)) < least:
                best, least = text, c
        if best is None and now >= 2 and "�" not in word:
            for legacy, meant in WORD_SWAPS:
                data = _bytes(word, legacy)
                text = data and _decoded(data, meant)
                if text and text != word and cost(text) < min(least, 0.5) and all(_kind(ch) in "al." for ch in text):
                    best, least = text, cost(text)
        if best is None:
            return word
        word = best
    return word


def _suspect(word: str) -> bool:
    """A word that may be Russian read as another one-byte encoding: rare letters, odd case, or accents on most letters."""
    wide = [ch for ch in word if "Ѐ" <= ch < "԰"]
    if len(wide) >= 3:
        return russian(word) < 42 or any(a.islower() and b.isupper() for a, b in zip(wide, wide[1:]))
    return sum("À" <= ch < "ɐ" for ch in word) >= 3 and cost(word) >= 2


def _gain(word: str, turned: str | None) -> float:
    """By how much the letters of a word become more Russian, negative for none."""
    if turned is None:
        return -50.0
    score = lambda w: russian(w) * sum("Ѐ" <= ch < "԰" for ch in w) - 40 * cost(w)
    return score(turned) - score(word)


def _swaps(word: str) -> tuple[list[float], list[str]]:
    """For each pair of one-byte encodings the gain and the new word."""
    if word.isascii():
        return [0.0] * len(LINE_SWAPS), [word] * len(LINE_SWAPS)
    gains, turned = [], []
    for legacy, meant in LINE_SWAPS:
        data = _bytes(word, legacy)
        text = data and _decoded(data, meant)
        gains.append(_gain(word, text))
        turned.append(text or word)
    return gains, turned


class Repair:
    """Restores texts; the words it has seen are kept, up to a bound."""

    KEPT = 200_000

    def __init__(self) -> None:
        self.words: dict[str, tuple[str, bool, bool]] = {}
        self.swaps: dict[str, tuple[list[float], list[str]]] = {}

    def word(self, word: str) -> tuple[str, bool, bool]:
        """The word restored, whether it is garbled, and whether it may be Russian in another encoding."""
        if (known := self.words.get(word)) is None:
            text = _fold(word)
            known = text, text != word or cost(text) >= 2, _suspect(text)
            if len(self.words) > self.KEPT:
                self.words.clear()
            self.words[word] = known
        return known

    def swapped(self, words: list[str]) -> dict[int, str]:
        """New words by position: the stretch that another one-byte encoding makes most Russian, if clearly so."""
        all_swaps = []
        for w in words:
            if (known := self.swaps.get(w)) is None:
                if len(self.swaps) > self.KEPT:
                    self.swaps.clear()
                known = self.swaps[w] = _swaps(w)
            all_swaps.append(known)
        best, most = {}, 150.0
        for pair in range(len(LINE_SWAPS)):
            total, start = 0.0, 0
            for i, (gains, _) in enumerate(all_swaps):
                if total <= 0:
                    total, start = 0.0, i
                total += gains[pair]
                if total > most:
                    most, best = total, {k: all_swaps[k][1][pair] for k in range(start, i + 1)}
        return best

    def text(self, text: str) -> tuple[str, int]:
        """The text restored where it can be, and the number of its garbled stretches."""
        if text.isascii():
            return text, 0
        found, lines = 0, text.split("\n")
        for i, line in enumerate(lines):
            if line.isascii():
                continue
            pieces = _WORDS.split(line)
            suspect = False
            for k in range(0, len(pieces), 2):
                if not pieces[k].isascii():
                    pieces[k], bad, odd = self.word(pieces[k])
                    found += bad
                    suspect |= odd
            if suspect:
                for k, w in self.swapped(pieces[::2]).items():
                    found += w != pieces[2 * k]
                    pieces[2 * k] = w
            lines[i] = "".join(pieces)
        return "\n".join(lines), found


def _repair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repair = Repair()
    for batch in batches:
        done = [repair.text(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], ["id", "text", "n_garbled"])


def repaired(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``<id_col>, n_garbled, text``: rows with garbled stretches, their number, and the text restored as far as it can be.

    Texts in ASCII, null and empty ones can't be garbled and give no rows; a text of which nothing can be restored comes
    out as it was. Repeated rows come out once each. Other columns are not looked at.
    """
    at_risk = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike("[^\\x00-\\x7F]"))
    kind = at_risk.schema["id"].dataType.simpleString()
    done = at_risk.mapInArrow(_repair_batches, f"id {kind}, text string, n_garbled int").filter("n_garbled > 0")
    return done.select(F.col("id").alias(id_col), "n_garbled", "text")


def p3_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated deliveries are told by what comes out; the texts themselves are not shuffled."""
    return repaired(chunk_rows(spark, sf), "uid", "text").distinct()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return repaired(chunk_rows(spark, sf), "uid", "text").select("uid").distinct()


QUERIES = {"p3_found": p3_found, "p3_repaired": p3_repaired}
ORACLE: dict[str, str] = {}
