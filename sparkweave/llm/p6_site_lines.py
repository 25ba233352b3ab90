"""Problem 6: lines repeated across one site's documents.

Lines are masked, those of a site are clustered by locality-sensitive hashing of five-word shingles, and clusters that
stand under many URLs of the site are taken out. Buckets in few places are dropped first, on hashes alone; URLs are
counted and lines compared only in the buckets left.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.lines import chunk_lines, chunk_rows, same_line, site_of
from sparkweave.operators.skew import skew_lookup
from sparkweave.session import materialize

BANDS, ROWS, SHINGLE, SIMILAR = 4, 2, 5, 0.8
#: Names of months in the languages of the pages, masked as dates.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|januar|februar|märz|mai|juni|juli|oktober|dezember|janvier|février|mars|avril|juin|juillet|août|septembre|octobre|novembre|décembre|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre|janeiro|fevereiro|março|maio|junho|julho|setembro|outubro|dezembro"


def one_of(words: list[str]) -> str:
    """A regular expression of these words that tries each letter once, in place of each word."""
    heads = dict.fromkeys(w[0] for w in words if w)
    each = [re.escape(h) + one_of([w[1:] for w in words if w[:1] == h]) for h in heads]
    return "" if not each else f"(?:{'|'.join(each)}){'?' if '' in words else ''}"


_MONTH = one_of(sorted(MONTHS.split("|")))


def mask(line: Column, names: bool = True) -> Column:
    """The line with numbers, dates and capitalised words that follow another word (names) put as signs.

    Without ``names`` equal lines have equal masks, whatever their case.
    """
    low = same_line(F.regexp_replace(line, r"\p{Lu}(?<=[\p{L},.] \p{Lu})[\p{Ll}'’-]+(?: \p{Lu}[\p{Ll}'’-]+)*", "N") if names else line)
    return F.regexp_replace(low, rf"(?:0 )?\b{_MONTH}\b(?:,? 0)?", "D")


_ODD = np.array([2 * k * 0x9E3779B97F4A7C15 + 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF | 1 for k in range(1, BANDS * ROWS + 1)], np.uint64)
_POWERS = np.array([pow(0x100000001B3, k, 1 << 64) for k in range(SHINGLE)], np.uint64)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each five words running (of all words where there are fewer) of all texts, and where each text's begin."""
    words = [t.split(" ") for t in texts]
    n = np.array([len(w) for w in words])
    at = np.concatenate([[0], np.cumsum(n)])
    flat = np.fromiter((zlib.crc32(w.encode()) for ws in words for w in ws), np.uint64, at[-1])
    flat = np.concatenate([flat + np.uint64(1), np.zeros(SHINGLE, np.uint64)])
    rolled = sum(flat[k : k + at[-1]] * _POWERS[k] for k in range(SHINGLE))  # runs past a text's end are left out below
    for i in np.flatnonzero(n < SHINGLE):
        rolled[at[i]] = (flat[at[i] : at[i + 1]] * _POWERS[: n[i]]).sum(dtype=np.uint64)
    count = np.maximum(n - SHINGLE + 1, 1)
    grams = rolled[np.arange(at[-1]) - np.repeat(at[:-1], n) < np.repeat(count, n)]
    return grams ^ (grams >> np.uint64(29)), np.concatenate([[0], np.cumsum(count)])


def _bands(texts: list[str], site: np.ndarray, bands: int) -> np.ndarray:
    """The buckets, by site, of the first bands of the minima of each text's shingles."""
    grams, start = _grams(texts)
    out = np.empty((len(texts), bands), np.uint64)
    for b in range(bands):
        h = site + np.uint64(b + 1)
        for odd in _ODD[b * ROWS : (b + 1) * ROWS]:
            h = (h ^ np.minimum.reduceat((m := grams * odd) ^ (m >> np.uint64(32)), start[:-1])) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(33)
        out[:, b] = h
    return out


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


def _bucketed(bands: int, text: bool):
    """Batches with the buckets of the masked lines and, with ``text``, these themselves; equal lines are hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, first, which = np.unique(batch.column(6).to_numpy(), return_index=True, return_inverse=True)
            texts = batch.column(7).take(pa.array(first)).to_pylist()
            buckets = _bands(texts, batch.column(5).to_numpy()[first].astype(np.uint64), bands)[which]
            columns = [*batch.columns[:5], _lists(buckets.ravel(), np.arange(0, bands * batch.num_rows + 1, bands)), *batch.columns[7:][: int(text)]]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "line_no", "h1", "h2", "u", "buckets", "masked"][: len(columns)])

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(*_grams(batch.column(1).to_pylist()))], ["h1", "grams"])


def site_lines(chunks: DataFrame) -> DataFrame:
    """``uid, url, site, line_no, line, h1, h2``: each line that isn't empty once normalised; h1 and h2 name it in its site.

    Chunks without url, host or text give no rows.
    """
    rows = chunk_lines(chunks.filter("url is not null and text is not null").withColumn("site", site_of(F.col("url"))).filter("site is not null"))
    rows = rows.withColumn("norm", same_line(F.col("line"))).filter("norm <> ''")
    return rows.withColumn("h1", F.xxhash64("site", "norm")).withColumn("h2", F.xxhash64("norm", F.lit(7), "site"))


def placed(lines: DataFrame, bands: int = BANDS, names: bool = True, text: bool = False) -> DataFrame:
    """``uid, line_no, h1, h2, u, buckets``: each place of a line with hashes of the line and the URL and the line's buckets;
    with ``text`` the masked line too."""
    site, masked = F.xxhash64("site").alias("s"), mask(F.col("line"), names).alias("masked")
    rows = lines.select("uid", "line_no", "h1", "h2", F.xxhash64("url").alias("u"), site, masked).withColumn("m", F.xxhash64("s", "masked"))
    kind = rows.schema["uid"].dataType.simpleString()
    rows = rows.select("uid", "line_no", "h1", "h2", "u", "s", "m", "masked")
    return rows.mapInArrow(_bucketed(bands, text), f"uid {kind}, line_no int, h1 long, h2 long, u long, buckets array<long>" + ", masked string" * text)


def line_types(places: DataFrame) -> DataFrame:
    """``h1, h2, n_urls, n_rows, buckets`` of each different line of a site; where equal lines have several masks, buckets of one."""
    of_url = places.groupBy("h1", "h2", "u").agg(F.count(F.lit(1)).alias("n"), F.min("buckets").alias("buckets"))
    return of_url.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_urls"), F.sum("n").alias("n_rows"), F.min("buckets").alias("buckets"))


def clustered(lines: DataFrame) -> DataFrame:
    """The different lines of each site with the buckets that cluster them."""
    return materialize(line_types(placed(lines)), "p6-types")


def _exact(lines: DataFrame, min_urls: int) -> DataFrame:
    """A line and all its equals share the first bucket, so those of a bucket in fewer places are out before URLs are counted."""
    rows = materialize(placed(lines, 1, names=False).select("uid", "line_no", "h1", "u", F.col("buckets")[0].alias("bucket")), "p6-places")
    large = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= min_urls), "p6-buckets")
    left = materialize(skew_lookup(rows, large, "bucket", "n_rows", F.struct("h1", "u")), "p6-left")
    of_url = left.groupBy("h1", "bucket", "u").agg(F.count(F.lit(1)).alias("n"))
    counts = of_url.groupBy("h1", "bucket").agg(F.count(F.lit(1)).alias("n_urls"), F.sum("n").alias("n_rows")).filter(F.col("n_urls") >= min_urls)
    chosen = materialize(counts.select("h1", F.col("bucket").alias("_b"), "n_rows"), "p6-chosen")
    return skew_lookup(left, chosen, "h1", "n_rows", F.struct("uid", "line_no")).filter("bucket = _b").select("uid", "line_no").distinct()


_LED = "h1 long, h2 long, cluster long, n_rows long"


def _led(rows: pa.Table) -> pa.Table:
    """The lines of a bucket under their leaders: from the most URLs down, a line unlike each leader so far is one itself.

    Of two lines with enough in common, each has one of the other's least hashes among its own, as many as may be lacking
    and one more; so a line is compared only with leaders that have one of these.
    """
    h1, h2, urls, grams = (rows[c].to_pylist() for c in ("h1", "h2", "n_urls", "grams"))
    sets, index, led = [frozenset(g) for g in grams], defaultdict(list), []
    for i in sorted(range(len(sets)), key=lambda i: (urls[i], h1[i], h2[i]), reverse=True):
        n = len(sets[i])
        least = sorted(sets[i])[: n - ceil(round(SIMILAR * n, 6)) + 1]
        near = [x for x in {x for g in least for x in index[g]} if len(both := sets[i] & sets[x]) >= SIMILAR * (n + len(sets[x]) - len(both))]
        if not near:
            near = [i]
            for g in least:
                index[g].append(i)
        led += [(i, x) for x in near]
    lines, leaders = (pa.array([x[k] for x in led], pa.int64()) for k in (0, 1))
    return pa.table({"h1": rows["h1"].take(lines), "h2": rows["h2"].take(lines), "cluster": rows["cluster"].take(leaders), "n_rows": rows["n_rows"].take(lines)})


def _alike(types: DataFrame, places: DataFrame, min_urls: int) -> DataFrame:
    """``h1, h2, cluster, n_rows`` of the lines that share a bucket with others and don't stand under enough URLs all by themselves.

    A bucket's first leader is the line that stands under most URLs; lines unlike it get further leaders until none is left.
    """
    each = types.select("h1", "h2", "n_urls", "n_rows", F.explode("buckets").alias("bucket"))
    buckets = each.groupBy("bucket").agg(F.sum("n_urls").alias("n"), F.count(F.lit(1)).alias("n_types"), F.min("n_urls").alias("fewest"))
    shared = materialize(buckets.filter((F.col("n") >= min_urls) & (F.col("n_types") > 1) & (F.col("fewest") < min_urls)).select("bucket", "n_types"), "p6-buckets")
    members = materialize(skew_lookup(each, shared, "bucket", "n_types", F.col("h1")), "p6-members")
    own = materialize(members.groupBy("h1").agg(F.max("n_rows").alias("n_rows")), "p6-own")
    texts = skew_lookup(places.select("uid", "h1", "masked"), own, "h1", "n_rows", F.col("uid")).groupBy("h1").agg(F.min("masked").alias("masked"))
    grams = materialize(texts.mapInArrow(_shingled, "h1 long, grams array<long>"), "p6-grams")
    members = members.join(grams, "h1")
    leaders = members.groupBy("bucket").agg(F.max_by(F.struct("grams", F.xxhash64("h1", "h2").alias("cluster")), F.struct("n_urls", "h1", "h2")).alias("l"), F.count(F.lit(1)).alias("n_types"))
    leaders = materialize(leaders.select("bucket", F.col("l.grams").alias("leader"), "l.cluster", "n_types"), "p6-leaders")
    alike = F.size(F.array_intersect("grams", "leader")) >= SIMILAR * F.size(F.array_union("grams", "leader"))
    compared = materialize(skew_lookup(members, leaders, "bucket", "n_types", F.col("h1")).withColumn("alike", alike).drop("leader"), "p6-compared")
    left = compared.filter("not alike")
    left = left.join(left.groupBy("bucket").agg(F.sum("n_urls").alias("n")).filter(F.col("n") >= min_urls).select("bucket"), "bucket", "left_semi")
    further = left.select("bucket", "h1", "h2", F.xxhash64("h1", "h2").alias("cluster"), "n_urls", "n_rows", "grams").groupBy("bucket").applyInArrow(_led, _LED)
    return materialize(compared.filter("alike").select("h1", "h2", "cluster", "n_rows").unionByName(further).distinct(), "p6-alike")


def _together(lines: DataFrame, min_urls: int) -> DataFrame:
    places = materialize(placed(lines, text=True), "p6-places")
    types = materialize(line_types(places), "p6-types")
    members = _alike(types, places, min_urls)
    of_url = places.select("h1", "h2", "u").distinct().withColumn("_k", F.xxhash64("h1", "h2"))
    sets = members.groupBy(F.xxhash64("h1", "h2").alias("_k")).agg(F.collect_set("cluster").alias("clusters"), F.max("n_rows").alias("n_rows"))
    full = skew_lookup(of_url, materialize(sets, "p6-sets"), "_k", "n_rows", F.col("u")).select("u", F.explode("clusters").alias("cluster")).distinct().groupBy("cluster").count().filter(F.col("count") >= min_urls)
    own = types.filter(F.col("n_urls") >= min_urls).select("h1", "h2", "n_rows")
    chosen = own.unionByName(members.join(full, "cluster", "left_semi").select("h1", "h2", "n_rows")).groupBy("h1", "h2").agg(F.max("n_rows").alias("n_rows"))
    chosen = materialize(chosen.select("h1", F.col("h2").alias("_h2"), "n_rows"), "p6-chosen")
    return skew_lookup(places.select("uid", "line_no", "h1", "h2"), chosen, "h1", "n_rows", F.struct("uid", "line_no")).filter("h2 = _h2").select("uid", "line_no").distinct()


def repeated_lines(lines: DataFrame, min_urls: int = 5, exact: bool = True) -> DataFrame:
    """``uid, line_no`` of each place of a repeated line.

    With ``exact`` a line counts if it itself stands under ``min_urls`` URLs of its site. Else all lines of
    a cluster do that together stand under so many, where those belong together that have 0.8 or more of their
    shingles in common with a leader they share a bucket with. Repeated rows count once.
    """
    return _exact(lines, min_urls) if exact else _together(lines, min_urls)


def cleaned(chunks: DataFrame, min_urls: int = 5) -> DataFrame:
    """``uid, n_removed, text``: the texts without the lines of repeated clusters. Chunks without url keep theirs."""
    gone = repeated_lines(site_lines(chunks), min_urls, exact=False).groupBy("uid").agg(F.collect_set("line_no").alias("gone"))
    whole = chunks.groupBy("uid").agg(F.max_by("text", F.struct("url", "text")).alias("text")).join(gone, "uid", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return whole.select("uid", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines(site_lines(chunk_rows(spark, sf)))


def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    return cleaned(chunk_rows(spark, sf))


QUERIES = {"p6_found": p6_found, "p6_clean": p6_clean}
ORACLE = {
    "p6_found": r"""
with c as (select distinct uid, url, text from text_chunk where uid is not null and url is not null and text is not null),
s as (select *, regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/:?#]+)', 1), '\.+$', ''), '^www\.', '') as site from c),
l as (select uid, url, site, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from s where site <> ''),
n as (select uid, url, site, line_no, regexp_replace(trim(regexp_replace(lower(line), '[ ' || chr(9) || chr(160) || ']+', ' ', 'g')), '[0-9]+', '0', 'g') as norm from l),
r as (select site, norm from n where norm <> '' group by 1, 2 having count(distinct url) >= 5)
select distinct n.uid, n.line_no from n join r on n.site = r.site and n.norm = r.norm
"""
}
