"""Problem 10: missing or wrong language labels, by error-correcting output codes.

Each language has a codeword of bits; a binary classifier over hashed character n-grams predicts each bit, and the
codeword of least weighted loss is chosen. The gap to the next best gives the confidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.sources.tables import read_table

#: Languages, and the names and codes by which labels call them.
LANGUAGES = ("de", "en", "es", "fr", "it", "ja", "nl", "pt", "ru")
NAMES = {
    "de": "de deu ger german", "en": "en eng english", "es": "es spa spanish castilian", "fr": "fr fra fre french", "it": "it ita italian", "ja": "ja jpn japanese",
    "nl": "nl nld dut dutch flemish", "pt": "pt por portuguese", "ru": "ru rus russian",
}
CODES = {name: lang for lang, names in NAMES.items() for name in names.split()}
#: Bits of a codeword, hashed features, labelled texts of a language and characters of each that are used to fit.
BITS, FEATURE_BITS, PER_LANGUAGE, FIT_CHARS = 15, 15, 400, 600
FEATURES = 1 << FEATURE_BITS
#: Sizes of n-grams, what is added to counts, and how log odds become bits.
SIZES, SMOOTH, SHARP = (2, 3, 4), 0.5, 3.0
#: Letters that make a line running text, and the confidence from which a line or document counts.
MIN_LETTERS, MIN_WORDS, CONFIDENT = 12, 3, 0.1
#: The share of a document from which its main language is beyond doubt.
MAJORITY = 0.5
_LETTERS = re.compile(r"[^\W\d_]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")


def label_language(label: Column) -> Column:
    """The language that a label names: a code of two or three letters with or without region, or an English name; else null."""
    word = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    table = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.element_at(table, word)


def codewords(bits: int = BITS) -> np.ndarray:
    """+1 and -1 by language and bit: the first languages' rows of a fixed set of balanced random columns, far from each other."""
    rng = np.random.default_rng(7)
    best, far = None, -1
    for _ in range(300):
        m = rng.choice([-1, 1], size=(len(LANGUAGES), bits))
        if (abs(m.sum(axis=0)) >= len(LANGUAGES) - 2).any():
            continue
        d = min(int((m[i] != m[j]).sum()) for i in range(len(m)) for j in range(i))
        if d > far:
            best, far = m, d
    return best.astype(np.float32)


def running(line: str) -> str:
    """The letters of a line as words, lower case, if there is running text in it; else nothing."""
    words = _LETTERS.findall(line)
    letters = sum(map(len, words))
    if _WIDE.search(line):
        return " ".join(words).lower() if letters >= 6 else ""
    return " ".join(words).lower() if len(words) >= MIN_WORDS and letters >= MIN_LETTERS else ""


def _features(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each size the hashed n-gram that begins at each character of all texts, set between spaces, and where texts begin.

    An n-gram that runs past its text's end is the feature ``FEATURES``, which counts for nothing.
    """
    padded = [f" {t} " for t in texts]
    flat = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = np.array([len(p) for p in padded])
    at = np.concatenate([[0], np.cumsum(n)])
    left = np.repeat(at[1:], n) - np.arange(len(flat))
    tail = np.zeros(max(SIZES), np.uint64)
    flat = np.concatenate([flat, tail])
    out, h = [], np.zeros(len(left), np.uint64)
    for k in range(1, max(SIZES) + 1):
        h = h * np.uint64(0x100000001B3) + flat[k - 1 : k - 1 + len(left)] + np.uint64(k)
        if k in SIZES:
            mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            out.append(np.where(left >= k, (mixed >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), FEATURES))
    return out, at


class Model:
    """For each bit a naive Bayes classifier of its two groups of languages; its share of right answers weighs the loss."""

    def __init__(self, texts: list[str], languages: list[str]) -> None:
        self.code = codewords()
        place = {lang: i for i, lang in enumerate(LANGUAGES)}
        y = np.array([place[lang] for lang in languages], np.int64)
        counts = np.zeros((len(LANGUAGES), FEATURES + 1))
        held = np.arange(len(texts)) % 5 == 0
        for lang in np.unique(y):
            own = [t for t, c, out in zip(texts, y, held) if c == lang and not out] or [t for t, c in zip(texts, y) if c == lang]
            for feature in _features(own)[0]:
                counts[lang] += np.bincount(feature, minlength=FEATURES + 1)
        counts[:, FEATURES] = 0
        self.seen = np.isin(np.arange(len(LANGUAGES)), y)
        share = (counts[:, :FEATURES] + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * FEATURES)
        share[~self.seen] = 0
        mean = lambda sign: np.stack([share[(self.code[:, b] == sign) & self.seen].mean(axis=0) if ((self.code[:, b] == sign) & self.seen).any() else np.full(FEATURES, 1 / FEATURES) for b in range(BITS)], axis=1)
        self.weights = np.concatenate([np.log(mean(1)) - np.log(mean(-1)), np.zeros((1, BITS))]).astype(np.float32)
        self.trust = np.ones(BITS, np.float32)
        check = [(t, c) for t, c, out in zip(texts, y, held) if out]
        if check:
            right = (np.sign(self.bits([t for t, _ in check])) == self.code[[c for _, c in check]]).mean(axis=0)
            self.trust = np.clip(np.log((right + 0.02) / (1.02 - right)), 0.05, 4).astype(np.float32)

    def bits(self, texts: list[str]) -> np.ndarray:
        """Of each text the classifiers' mean log odds over its n-grams."""
        features, at = _features(texts)
        total = sum(np.add.reduceat(self.weights[f], at[:-1], axis=0) for f in features)
        return total / (len(features) * np.diff(at)[:, None])

    def decide(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The place of each text's language and its confidence, the gap of the weighted losses of the two nearest codewords."""
        soft = np.tanh(SHARP * self.bits(texts))
        loss = ((1 - soft[:, None, :] * self.code[None, :, :]) * self.trust).sum(axis=2) / (2 * self.trust.sum())
        loss[:, ~self.seen] = 2
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(texts))
        gap = loss[rows, order[:, 1]] - loss[rows, order[:, 0]]
        return order[:, 0], np.clip(gap, 0, 1)


def fit(docs: DataFrame, text: str, label: str, per_language: int = PER_LANGUAGE) -> Model:
    """A model from a bounded sample of labelled texts: of each language the ``per_language`` rows of least hash."""
    lang = label_language(F.col(label))
    rows = docs.select(F.substring(F.col(text), 1, FIT_CHARS).alias("t"), lang.alias("lang")).filter("lang is not null and t is not null and length(trim(t)) >= 40")
    ranked = rows.withColumn("h", F.xxhash64("t")).selectExpr("t", "lang", "row_number() over (partition by lang order by h, t) as r").filter(F.col("r") <= per_language)
    got = sorted((r["lang"], r["t"]) for r in ranked.select("t", "lang").collect())
    pairs = [(t, r[0]) for r in got for line in r[1].split("\n") if (t := running(line))]
    return cleaned_fit(pairs)


def cleaned_fit(pairs: list[tuple[str, str]], rounds: int = 3) -> Model:
    """Some labels are wrong and some lines of another language: what a model puts elsewhere is left out of the next one."""
    model = Model([t for t, _ in pairs], [lang for _, lang in pairs])
    for _ in range(rounds - 1 if pairs else 0):
        chosen, _ = model.decide([t for t, _ in pairs])
        kept = [p for p, c in zip(pairs, chosen) if LANGUAGES[c] == p[1]]
        model = Model([t for t, _ in kept], [lang for _, lang in kept])
    return model


_SEGMENTS = "doc {kind}, line_no int, lang string, confidence double, ambiguous boolean, label_right boolean"


def _detector(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                where, texts = [], []
                for d, text in enumerate(batch.column(1).to_pylist()):
                    for no, line in enumerate(text.split("\n")):
                        if t := running(line):
                            where.append((d, no, len(t) * (3 if _WIDE.search(t) else 1)))
                            texts.append(t)
                out: list[tuple[int, int, str, float, bool, bool | None]] = []
                if texts:
                    lang, gap = model.decide(texts)
                    votes = np.zeros((batch.num_rows, len(LANGUAGES)))
                    for (d, _, size), c, g in zip(where, lang, gap):
                        votes[d, c] += size * (0.1 + g)
                    main = votes.argmax(axis=1)
                    share = votes.max(axis=1) / np.maximum(votes.sum(axis=1), 1e-9)
                    labels = batch.column(2).to_pylist()
                    for d in sorted({d for d, _, _ in where}):
                        out.append((d, -1, LANGUAGES[main[d]], float(share[d]), bool(share[d] < MAJORITY), labels[d] == LANGUAGES[main[d]]))
                    out += [(d, no, LANGUAGES[c], float(g), bool(g < CONFIDENT), None) for (d, no, _), c, g in zip(where, lang, gap) if c != main[d]]
                rows = list(zip(*out)) if out else [[]] * 6
                docs = batch.column(0).take(pa.array(rows[0], pa.int32()))
                kinds = (pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([docs, *(pa.array(r, t) for r, t in zip(rows[1:], kinds))], ["doc", "line_no", "lang", "confidence", "ambiguous", "label_right"])

    return run


def languages(docs: DataFrame, doc_id: str, text: str, label: str, model: Model | None = None) -> DataFrame:
    """``<doc_id>, line_no, lang, confidence, ambiguous, label_right``: of each document with running words its main
    language, with line_no -1, and of each of its lines that is nearer to another one that language.

    ``confidence`` of a line is the gap between the two nearest codewords, that of a document its main language's share.
    ``ambiguous`` marks lines whose gap is under ``CONFIDENT``, such as those in a language the model doesn't know, and
    documents whose main language has under half. ``label_right`` tells for line_no -1 whether the label names the main
    language. Null, empty and blank texts and lines of figures and signs give no rows; repeated rows come out once. The
    fit uses a bounded sample; the texts themselves are not shuffled.
    """
    model = model or fit(docs, text, label)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), label_language(F.col(label)).alias("label")).filter("text is not null")
    found = rows.mapInArrow(_detector(model), _SEGMENTS.format(kind=kind))
    return found.select(F.col("doc").alias(doc_id), "line_no", "lang", F.round("confidence", 4).alias("confidence"), "ambiguous", "label_right").distinct()


def p10_languages(spark: SparkSession, sf: str) -> DataFrame:
    return languages(read_table(spark, sf, "documents"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_languages(spark, sf).filter("line_no >= 0 and not ambiguous or not label_right").select("doc_id", "line_no", "lang")


QUERIES = {"p10_found": p10_found, "p10_languages": p10_languages}
ORACLE: dict[str, str] = {}
