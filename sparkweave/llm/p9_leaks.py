"""Problem 9: evaluation texts in training text, by a BM25 index of the items with block-max pruning.

The index of a bounded part of the items goes to every task; more items are searched part by part. Windows of a
document's words are the queries. As in block-max WAND a window is dropped if the greatest scores of its terms don't
reach the least threshold, then its blocks of items whose greatest scores don't reach theirs; only postings of the
blocks left are scored. This is done for all windows of a batch at once, by sums over arrays, in place of moving
cursors. Items over their own threshold are verified by an alignment of words, question and answer apart.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.session import materialize
from sparkweave.sources.tables import read_table

#: The most items of one index, which is broadcast; more are searched in parts of about so many.
PART_ITEMS = 50_000
#: Words of a window and from one window to the next, words that must run, and items of a block.
WINDOW, STRIDE, RUN, BLOCK = 48, 24, 12, 16
K1, B = 1.2, 0.4
#: Words of a larger share of the items are stock words; what is left of a score when words are changed.
STOCK_WORD, CHANGED = 0.06, 0.4
#: Share of a run's words, and of their weight (1 for a word of one item, 0 for a stock word), that must be the item's.
SAME_WORDS, SAME_WEIGHT, LEAST_OWN = 0.75, 0.75, 1.0
#: Words by which an added or left out word may move what follows.
SHIFT = 3
#: Words of a sentence of an item that is found apart from the others.
APART = 6
#: Characters of the texts that are searched at once.
AT_ONCE = 2_000_000
_WORD = re.compile(r"[^\W_]+")
_ACCENTS = re.compile("[\u0300-\u036f]+")
_MARKS = dict.fromkeys(map(ord, "\u200b\u200c\u200d\u2060\ufeff\u00ad'\u2019"), None)
#: What begins the answer of an item; without it the text after the last question mark is the answer, if there is any.
_ANSWER = re.compile(r"\b(?:answer|rationale|solution|explanation)\s*:", re.I)
_SENTENCE = re.compile(r"[.!?:;]+[\s\"'\u201d\u2019)\]]+")


def words_of(text: str) -> list[str]:
    """Lower-case words without accents, apostrophes and invisible marks; figures are words."""
    if text.isascii():
        return _WORD.findall(text.replace("'", "").lower())
    return _WORD.findall(_ACCENTS.sub("", unicodedata.normalize("NFKD", text)).translate(_MARKS).lower())


def answer_at(text: str) -> int:
    """The number of words before an item's answer; all of them if it has none."""
    m = _ANSWER.search(text)
    cut = m.start() if m else text.rfind("?") + 1
    return len(words_of(text[:cut])) if 0 < cut < len(text) else len(words_of(text))


def _spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges that begin at ``start`` and have ``n`` members: for each member its range's place and itself."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups of equal keys begin, which are sorted, with the end."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(change)
    return start, np.append(start, len(change))


class Index:
    """BM25 postings of the items' pairs of words, with the maxima of each term and of each term in a block of items.

    Maxima are kept for the blocks a term stands in only, so the index grows with the items' words.
    """

    def __init__(self, items: list[tuple[int, str]], of_all: tuple[int, dict[str, int]] | None = None) -> None:
        """``of_all`` has the number of all items and of those with each word, where these are a part of them."""
        n = len(items)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.vocabulary: dict[str, int] = {}
        words = [words_of(t) for _, t in items]
        self.size = np.array([len(w) for w in words], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        put = self.vocabulary.setdefault
        self.flat = np.array([put(w, len(self.vocabulary)) for ws in words for w in ws], np.int64)
        item = np.repeat(np.arange(n), self.size)
        place = np.arange(len(self.flat)) - np.repeat(self.at[:-1], self.size)
        self.answer = np.array([answer_at(t) for _, t in items], np.int64)
        # word places that begin a sentence of their item
        self.sentences = [np.unique(np.minimum(np.cumsum([0, *(len(words_of(x)) for x in _SENTENCE.split(t))]), len(w)))[:-1] for (_, t), w in zip(items, words)]
        v, many = max(1, len(self.vocabulary)), max(STOCK_WORD * (of_all[0] if of_all else n), 3.0)
        df = np.array([of_all[1][w] for w in self.vocabulary]) if of_all else np.bincount(np.unique(self.flat * max(n, 1) + item) // max(n, 1), minlength=v)
        # 1 for a word of one item alone, 0 for a stock word
        self.weight = np.clip(np.log(many / np.maximum(df, 1)) / np.log(many), 0, 1)
        # pairs of a word and the next of the item; an item of one word is a pair with none
        first = np.flatnonzero((place < self.size[item] - 1) | (self.size[item] == 1))
        code = np.where(self.size[item[first]] == 1, -2 - self.flat[first], self.flat[first] * v + self.flat[np.minimum(first + 1, len(self.flat) - 1)]) if len(first) else first
        self.terms, term = np.unique(code, return_inverse=True)
        order = np.lexsort((place[first], item[first], term))
        term, self.posting_item, self.posting_place, origin = term[order], item[first][order], place[first][order], first[order]
        self.term_at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        begin, end = _groups(term, self.posting_item)
        tf = np.diff(end)
        counts = np.bincount(term[begin], minlength=len(self.terms))
        idf = np.log(1 + (n - counts + 0.5) / (counts + 0.5))
        mean = max(1.0, self.size.mean()) if n else 1.0
        weight = idf[term[begin]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.size[self.posting_item[begin]] / mean))
        # a term's postings in one item count once: with the first of them
        self.posting_weight = np.zeros(len(term))
        self.posting_weight[begin] = weight
        self.term_max = np.zeros(len(self.terms))
        np.maximum.at(self.term_max, term[begin], weight)
        begin, self.block_at = _groups(term, self.posting_item // BLOCK)
        self.block = (self.posting_item // BLOCK)[begin]
        self.block_max = np.maximum.reduceat(self.posting_weight, begin) if len(begin) else np.zeros(0)
        self.blocks_at = np.searchsorted(term[begin], np.arange(len(self.terms) + 1))
        self.n_blocks = max(1, -(-n // BLOCK))
        order = np.lexsort((place, self.flat * max(n, 1) + item))
        self.word_key, self.word_place = (self.flat * max(n, 1) + item)[order], place[order]
        self.least, self.pairs = self._thresholds(n, origin)
        self.block_least = np.full(self.n_blocks, np.inf)
        np.minimum.at(self.block_least, np.arange(n) // BLOCK, self.least)

    def sizes(self, n: int) -> list[int]:
        """Sizes of the runs that are looked for in an item of ``n`` words."""
        need = min(RUN, n)
        return sorted({need, min(n, need + 4), min(n, 2 * need), n})

    def _thresholds(self, n: int, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each item what its lightest run that can be reported scores, less what changed words take, and how many
        pairs of such a run are left at least on near diagonals."""
        pair = np.zeros(len(self.flat))
        pair[origin] = self.posting_weight
        least, pairs = np.full(n, np.inf), np.ones(n, np.int64)
        for d in range(n):
            lo, hi = self.at[d], self.at[d + 1]
            size = int(hi - lo)
            if not size:
                continue
            scored, own = np.concatenate([[0], np.cumsum(pair[lo:hi])]), np.concatenate([[0], np.cumsum(self.weight[self.flat[lo:hi]])])
            low = scored[-1]
            for run in self.sizes(size):
                k = np.arange(size - run + 1)
                fine = own[k + run] - own[k] >= LEAST_OWN
                if fine.any():
                    low = min(low, (scored[np.maximum(k + run - 1, k + 1)] - scored[k])[fine].min())
            least[d] = max(CHANGED * low, 1e-6)
            run = min(RUN, size)
            pairs[d] = max(1, run - 1 - 2 * int((1 - SAME_WORDS) * run) - 1)
        return least - 1e-9, pairs

    def _term(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.full(len(a), -1)
        code = np.where((a >= 0) & (b >= 0), a * max(1, len(self.vocabulary)) + b, -1)
        at = np.minimum(np.searchsorted(self.terms, code), len(self.terms) - 1)
        return np.where((self.terms[at] == code) & (code >= 0), at, -1)

    def candidates(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, item and first word of each window, of texts put end to end, that may hold a run of the item."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(flat) or not len(self.terms):
            return none
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        follows = np.append(flat[1:], -1)
        follows[at[1:][np.diff(at) > 0] - 1] = -1
        term = self._term(flat, follows)
        if self.terms[0] < 0:  # items of one word
            lone = -2 - flat
            k = np.minimum(np.searchsorted(self.terms, lone), len(self.terms) - 1)
            single = np.flatnonzero((flat >= 0) & (self.terms[k] == lone))
        else:
            single = none[0]
        hit, of = np.flatnonzero(term >= 0), None
        of = term[hit]
        if len(single):
            hit, of = np.concatenate([hit, single]), np.concatenate([of, k[single]])
        place = hit - at[doc[hit]]
        windows = np.concatenate([[0], np.cumsum(-(-np.diff(at) // STRIDE))])  # of each document
        w = windows[doc[hit]] + place // STRIDE
        back = place >= STRIDE
        w, hit, of = np.concatenate([w, w[back] - 1]), np.concatenate([hit, hit[back]]), np.concatenate([of, of[back]])
        # 1: the greatest scores of a window's terms against the least threshold of all
        bound = np.bincount(w, weights=self.term_max[of], minlength=windows[-1])
        keep = bound[w] >= self.least.min()
        w, hit, of = w[keep], hit[keep], of[keep]
        if not len(w):
            return none
        order = np.lexsort((hit, of, w))
        w, hit, of = w[order], hit[order], of[order]
        once = _groups(w, of)[0]
        # 2: the greatest scores of its terms in each block against the block's least threshold
        owner, entry = _spread(self.blocks_at[of[once]], self.blocks_at[of[once] + 1] - self.blocks_at[of[once]])
        key = w[once][owner] * self.n_blocks + self.block[entry]
        keys, which = np.unique(key, return_inverse=True)
        alive = np.bincount(which, weights=self.block_max[entry]) >= self.block_least[keys % self.n_blocks]
        live = alive[which]
        owner, entry = owner[live], entry[live]
        # 3: the postings of what is left
        of_entry, posting = _spread(self.block_at[entry], self.block_at[entry + 1] - self.block_at[entry])
        n = len(self.ids)
        key = w[once][owner[of_entry]] * n + self.posting_item[posting]
        keys, which = np.unique(key, return_inverse=True)
        reached = np.bincount(which, weights=self.posting_weight[posting]) >= self.least[keys % n]
        if not reached.any():
            return none
        # 4: enough pairs on near diagonals
        fine = reached[which]
        which, posting, run = which[fine], posting[fine], once[owner[of_entry[fine]]]
        ends = np.append(once, len(w))
        length = ends[np.searchsorted(once, run) + 1] - run
        back_to, member = _spread(run, length)
        diagonal = hit[member] - at[doc[hit[member]]] - self.posting_place[posting[back_to]]
        width = 2 * (2 * SHIFT + 1)
        found = np.zeros(len(keys), bool)
        low = int(diagonal.min())
        span = (int(diagonal.max()) - low) // width + 2
        for phase in (0, width // 2):
            bands, n_pairs = np.unique(which[back_to] * span + (diagonal - low + phase) // width, return_counts=True)
            enough = n_pairs >= self.pairs[keys[bands // span] % n]
            found[bands[enough] // span] = True
        keys = keys[found]
        window = keys // n
        d = np.searchsorted(windows, window, "right") - 1
        return d, keys % n, (window - windows[d]) * STRIDE

    def likely(self, flat: np.ndarray, at: np.ndarray, d: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which candidates, sorted, have enough words of the item near one diagonal, and enough that few other items have."""
        n = max(1, len(self.ids))
        pair = np.cumsum(np.append(False, (d[1:] != d[:-1]) | (item[1:] != item[:-1])))
        lo, hi = np.maximum(start - STRIDE, 0), np.minimum(start + WINDOW + STRIDE, np.diff(at)[d])
        owner, place = _spread(lo, hi - lo)
        words = flat[place + at[d[owner]]]
        owner, place, words = owner[words >= 0], place[words >= 0], words[words >= 0]
        key = words * n + item[owner]
        left, right = np.searchsorted(self.word_key, key), np.searchsorted(self.word_key, key, "right")
        of, entry = _spread(left, right - left)
        i, diagonal, whose = self.word_place[entry], place[of] - self.word_place[entry], pair[owner[of]]
        longest = int(self.size.max())
        width = 2 * (2 * SHIFT + 1)
        low = int(diagonal.min())
        span = (int(diagonal.max()) - low) // width + 2
        size = self.size[item[np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))]]
        first_word = self.at[item[np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))]]
        fine = np.zeros(int(pair[-1]) + 1, bool)
        for phase in (0, width // 2):
            both = np.unique((whose * span + (diagonal - low + phase) // width) * longest + i)
            band, i_own = both // longest, both % longest
            p = band // span
            begin = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
            count = np.diff(np.append(begin, len(band)))
            own = np.add.reduceat(self.weight[self.flat[first_word[p] + i_own]], begin)
            p = p[begin]
            fine[p[(own >= LEAST_OWN - 1e-9) & (count >= SAME_WORDS * np.minimum(RUN, size[p])) | (count == size[p])]] = True
            # or sentences apart from each other
            part = (count >= APART) & (own > 0)
            several, mass = np.bincount(p[part], minlength=len(fine)), np.bincount(p[part], weights=own[part], minlength=len(fine))
            fine |= (several > 1) & (mass >= LEAST_OWN)
        return fine[pair]

    def verified(self, coded: np.ndarray, d: int, starts: np.ndarray) -> tuple[float, float] | None:
        """Shares of the item's question and answer that the document has, if it has its whole text or ``RUN`` words
        running of it near these windows; else nothing. A share without words is nan."""
        item = self.flat[self.at[d] : self.at[d + 1]]
        cut = int(self.answer[d])
        groups = np.split(starts, np.flatnonzero(np.diff(starts) > 2 * WINDOW) + 1)
        spans = [(max(0, int(g[0]) - 2 * WINDOW), min(len(coded), int(g[-1]) + 3 * WINDOW)) for g in groups]
        apart: list[tuple[int, np.ndarray]] = []
        best = None
        for lo, hi in spans:
            got = self._aligned(coded[lo:hi], item, self.sentences[d], lo, apart)
            if got is not None and (best is None or got.sum() > best.sum()):
                best = got
        if best is None and len(apart) > 1:
            best = self._chained(apart, item)
        if best is None:
            return None
        share = lambda x: float(x.mean()) if len(x) else float("nan")
        return share(best[:cut]), share(best[cut:])

    def _aligned(self, text: np.ndarray, item: np.ndarray, sentences: np.ndarray, offset: int, apart: list[tuple[int, np.ndarray]]) -> np.ndarray | None:
        """The item's words that stand in the text in order, if enough of a run are; sentences found are put in ``apart``."""
        n = len(item)
        there = np.isin(text, item)
        if not there.any():
            return None
        where: dict[int, list[int]] = {}
        for i, c in enumerate(item.tolist()):
            where.setdefault(c, []).append(i)
        # matches along each diagonal (text place - item place); an added or left out word moves to a near one
        hits: dict[int, list[int]] = {}
        for t in np.flatnonzero(there).tolist():
            for i in where[int(text[t])]:
                hits.setdefault(t - i, []).append(i)
        sizes, weight = self.sizes(n), self.weight[item]
        total = np.concatenate([[0], np.cumsum(weight)])
        ends = np.append(sentences[1:], n)
        for diagonal, own in hits.items():
            if len(own) < min(3, n):
                continue
            got = np.zeros(n, bool)
            for shift in range(-SHIFT, SHIFT + 1):
                near = hits.get(diagonal + shift)
                if near:
                    got[self._runs(near) if shift else near] = True
            if self._enough(got, weight, total, sizes):
                return got
            for a, b in zip(sentences.tolist(), ends.tolist()):
                if got[a:b].sum() >= max(SAME_WORDS * (b - a), min(3, b - a)):
                    part = np.zeros(n, bool)
                    part[a:b] = got[a:b]
                    apart.append((offset + diagonal + a, part))
        return None

    def _chained(self, apart: list[tuple[int, np.ndarray]], item: np.ndarray) -> np.ndarray | None:
        """Sentences of the item that stand in its order, with other text between, put together: the item's words so found."""
        chains: list[tuple[int, int, np.ndarray]] = []  # text place, item place of the last sentence, words
        for at, part in sorted(apart, key=lambda x: (x[0], int(np.argmax(x[1])))):
            a = int(np.argmax(part))
            before = max((c for c in chains if c[0] < at and c[1] < a), key=lambda c: int(c[2].sum()), default=None)
            chains.append((at, a, part | before[2] if before else part))
        weight = self.weight[item]
        total = np.concatenate([[0], np.cumsum(weight)])
        best = max(chains, key=lambda c: int(c[2].sum()))[2]
        return best if self._enough(best, weight, total, self.sizes(len(item))) else None

    @staticmethod
    def _enough(got: np.ndarray, weight: np.ndarray, total: np.ndarray, sizes: list[int]) -> bool:
        """Whether some run has enough of the item's words and of their weight, and starts and ends with words of its own."""
        count, mass = np.concatenate([[0], np.cumsum(got)]), np.concatenate([[0], np.cumsum(got * weight)])
        for size in sizes:
            k = np.arange(0, len(got) - size + 1)
            same, own, all_own = count[k + size] - count[k], mass[k + size] - mass[k], total[k + size] - total[k]
            fine = (same >= SAME_WORDS * size) & (own >= SAME_WEIGHT * all_own) & got[k] & got[k + size - 1]
            # a run of stock words with hardly a word of its own shows nothing, unless it is the whole text
            if (fine & ((own >= LEAST_OWN) | (size == len(got)) & (same == size))).any():
                return True
        return False

    @staticmethod
    def _runs(places: list[int]) -> list[int]:
        """Of places matched on a shifted diagonal only those that are three or more in a row."""
        have = set(places)
        starts = [p for p in have if p - 1 not in have and p + 1 in have and p + 2 in have]
        out = []
        for p in starts:
            while p in have:
                out.append(p)
                p += 1
        return out


def _code(get, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts as numbers, put end to end, and where each text begins."""
    flat: list[int] = []
    at = [0]
    for t in texts:
        flat += [get(w, -1) for w in words_of(t)]
        at.append(len(flat))
    return np.array(flat, np.int64), np.array(at, np.int64)


def _search(index: Index, texts: list[str]) -> Iterator[tuple[int, int, float, float]]:
    flat, at = _code(index.vocabulary.get, texts)
    d, item, start = index.candidates(flat, at)
    order = np.lexsort((start, item, d))
    d, item, start = d[order], item[order], start[order]
    if not len(d):
        return
    likely = index.likely(flat, at, d, item, start)
    d, item, start = d[likely], item[likely], start[likely]
    if not len(d):
        return
    begin, end = _groups(d, item)
    for i, j in zip(begin.tolist(), end[1:].tolist()):
        shares = index.verified(flat[at[d[i]] : at[d[i] + 1]], int(item[i]), start[i:j])
        if shares is not None:
            yield int(d[i]), int(index.ids[item[i]]), *shares


def _searcher(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            begin, size, found = 0, 0, []
            for k, t in enumerate(texts):
                size += len(t)
                if size >= AT_ONCE or k + 1 == len(texts):
                    found += [(begin + d, *x) for d, *x in _search(index, texts[begin : k + 1])]
                    begin, size = k + 1, 0
            rows = list(zip(*found)) if found else [[], [], [], []]
            docs = batch.column(0).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.float64())], ["doc", "item", "question", "answer"])

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [(p, w) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in set(words_of(t))]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in each], pa.int64()), pa.array([w for _, w in each], pa.string())], ["part", "word"])


def leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, part_items: int = PART_ITEMS) -> DataFrame:
    """``<doc_id>, <item_id>, question_share, answer_share`` of each document with an item's whole text or 12 words
    running of it, few of them changed; the shares are those of the words of the item's question and of its answer
    (null without one) found in order.

    Null and empty texts on either side hold nothing; documents and items that are repeated give each pair once; either
    table empty gives no rows. Over ``part_items`` items are searched in parts by hash; what counts as
    a stock word is taken from all of them.
    """
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null").distinct()
    n = rows.count()
    parts = max(1, -(-n // part_items))
    if parts > 1:
        rows = materialize(rows.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts))), "p9-items")
        words = materialize(rows.select("part", "t").mapInArrow(_item_words, "part long, word string").groupBy("part", "word").agg(F.count(F.lit(1)).alias("n")), "p9-words")
        of_all = words.groupBy("word").agg(F.sum("n").alias("df"))
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).filter("text is not null and text <> ''")
    found = None
    for part in range(parts):
        if parts > 1:
            own = rows.filter(F.col("part") == part)
            known = n, {r["word"]: r["df"] for r in words.filter(F.col("part") == part).join(of_all, "word").select("word", "df").collect()}
        else:
            own, known = rows, None
        listed = sorted((r["i"], r["t"]) for r in own.collect() if words_of(r["t"]))
        sent = docs.sparkSession.sparkContext.broadcast(Index(listed, known))
        here = texts.mapInArrow(_searcher(sent), f"doc {kind}, item long, question double, answer double")
        if parts > 1:
            here = materialize(here, "p9-found")
        found = here if found is None else found.unionByName(here)
    share = lambda c: F.round(F.max(F.when(~F.isnan(c), F.col(c))), 4)
    return found.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(share("question").alias("question_share"), share("answer").alias("answer_share"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(read_table(spark, sf, "documents"), "doc_id", "text", read_table(spark, sf, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """Of each leaked item how many documents hold it, and how many hold most of its question and of its answer."""
    most = lambda c: F.count_if(F.col(c) >= 0.5)
    return _leaks(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), most("question_share").alias("n_question"), most("answer_share").alias("n_answer"))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
ORACLE: dict[str, str] = {}
