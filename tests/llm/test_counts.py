"""Problems 1, 4 and 6 against brute force on small tables with nulls, repeats, hot keys and clashing columns."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from sparkweave.llm import lines, p1_cooccurrence, p4_frequency, p6_site_lines


def test_pairs(spark, monkeypatch):
    monkeypatch.setattr(p1_cooccurrence, "SEGMENT", 4)
    rng = random.Random(1)
    rows = [(rng.randrange(60), rng.randrange(3), rng.choice("abcdefghij") if rng.random() < 0.7 else "a") for _ in range(900)] + [(None, 1, "a"), (1, None, "b"), (1, 1, None)] * 3
    baskets = defaultdict(set)
    for c, s, k in rows:
        if None not in (c, s, k):
            baskets[c, s].add(k)
    ab = Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    n = Counter(k for b in baskets.values() for k in b)
    df = spark.createDataFrame(rows, "chunk_uid long, sent_id int, key string").withColumns({"items": F.lit("x"), "weight": F.lit(9)})
    got = {(r.key_a, r.key_b): r for r in p1_cooccurrence.associations(df, ["chunk_uid", "sent_id"], "key").collect()}
    assert {p: r.n_ab for p, r in got.items()} == {p: c for p, c in ab.items() if c >= 5}
    assert all(r.n_a == n[a] and r.n_b == n[b] and r.n == len(baskets) for (a, b), r in got.items())
    assert p1_cooccurrence.associations(df.limit(0), ["chunk_uid", "sent_id"], "key").count() == 0


def test_frequencies(spark):
    rows = [(i % 90, "hot" if i % 3 else f"k{i % 40}") for i in range(3000)] + [(None, "n"), (7, None)]
    df = spark.createDataFrame(rows, "record long, key string").withColumns({"id": F.lit(1), "n": F.lit("x")})
    got = {r.key: r for r in p4_frequency.frequencies(df, "key", "record").collect()}
    total, recs = Counter(k for _, k in rows if k), defaultdict(set)
    for r, k in rows:
        if k:
            recs[k].add(r)
    everything = len({r for r, k in rows if k})
    for k, r in got.items():
        mark = "rare" if len(recs[k]) <= 1 else "common" if len(recs[k]) > everything / 10 else None
        assert (r.n_occurrences, r.n_records, r.mark) == (total[k], len(recs[k]), mark)
    assert set(got) == set(total)
    assert p4_frequency.frequencies(df.limit(0), "key", "record").count() == 0


def _norm(line):
    return re.sub("[0-9]+", "0", re.sub("[ \t\u00a0]+", " ", line.lower()).strip(" "))


def test_site_lines(spark):
    rng = random.Random(2)
    urls = ["http://www.A.example:80/%d", "https://a.example/%d", "http://b.example/%d"]
    rows = []
    for i in range(60):
        text = "\n".join(rng.choice(["Follow us", "FOLLOW\t us ", f"Page {i} of 9", f"own {i} words {rng.random()}", "", " \xa0", "all rights are held here by us"]) for _ in range(5))
        rows.append((i, rng.choice(urls) % (i // 2), text))
    rows += rows[:5] + [(100, None, "Follow us"), (101, "http://a.example/1", None), (102, "", "Follow us"), (103, "http://a.example/9", "")]
    site = lambda u: re.sub(r"^www\.", "", re.match(r"https?://([^/:]+)", u.lower()).group(1))
    under, places = defaultdict(set), defaultdict(set)
    for uid, u, t in rows:
        if u and t is not None:
            for no, x in enumerate(t.split("\n")):
                if _norm(x):
                    under[site(u), _norm(x)].add(u)
                    places[site(u), _norm(x)].add((uid, no))
    want = {p for k, us in under.items() if len(us) >= 5 for p in places[k]}
    df = spark.createDataFrame(rows, "uid long, url string, text string").withColumns({"site": F.lit("q"), "line": F.lit("z"), "h1": F.lit(1)})
    df = df.select("uid", "url", "text")
    assert {tuple(r) for r in p6_site_lines.repeated_lines(p6_site_lines.site_lines(df)).collect()} == want
    texts = {r.uid: r for r in p6_site_lines.cleaned(df.filter("uid is not null and text is not null")).collect()}
    assert all("Follow us" not in r.text for u, r in texts.items() if u < 60 and ((u, 0) in want)) and texts[100].text == "Follow us"
    assert p6_site_lines.repeated_lines(p6_site_lines.site_lines(df.limit(0))).count() == 0


def test_near_lines(spark):
    base = "reproduction of any part of this page without written consent of the owner is not allowed"
    rows = [(i, f"http://s.example/{i}", base + (" today" if i % 2 else "")) for i in range(6)] + [(9, "http://s.example/x", "an article line that stands here alone in all of the site")]
    df = spark.createDataFrame(rows, "uid long, url string, text string")
    assert {r.uid for r in p6_site_lines.repeated_lines(p6_site_lines.site_lines(df)).collect()} == set()
    assert {r.uid for r in p6_site_lines.repeated_lines(p6_site_lines.site_lines(df), exact=False).collect()} == set(range(6))


def test_rarer_family(spark):
    """Near-duplicates all of whose buckets are led by another, more frequent line, unlike them."""
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    stem = [word() for _ in range(34)]
    frequent, family = " ".join([*stem, *(word() for _ in range(6))]), [word() for _ in range(5)]
    texts = [frequent] * 9 + [" ".join([*stem, *family, word()]) for _ in range(6)]
    df = spark.createDataFrame([(i, f"http://s.example/{i}", t) for i, t in enumerate(texts)], "uid long, url string, text string")
    found = p6_site_lines.site_lines(df)
    buckets = {tuple(sorted(r.buckets)) for r in p6_site_lines.clustered(found).collect()}
    assert len(buckets) == 1
    assert {r.uid for r in p6_site_lines.repeated_lines(found, exact=False).collect()} == set(range(15))
    assert {r.uid for r in p6_site_lines.repeated_lines(found, min_urls=7, exact=False).collect()} == set(range(9))


def test_few_arrays_of_many_identifiers():
    """Ids of ten million, of which one is hot: one pair of arrays for each block that a task meets."""
    rng = np.random.default_rng(2)
    ids = np.where(rng.random(30_000) < 0.3, 77, rng.integers(0, 10_000_000, 30_000))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.ones(len(ids), np.int64))], ["id", "n"])
    summed = pa.Table.from_batches(p4_frequency._presummed(batch.slice(i, 10_000) for i in range(0, 30_000, 10_000)))
    assert summed.num_rows <= np.unique(ids).size + 300
    of_task = summed.filter(pc.less(summed["block"], 64)).sort_by("block")
    out = pa.Table.from_batches(p4_frequency._arrays(of_task.to_batches(max_chunksize=50)))
    assert out.num_rows == np.unique(of_task["block"].to_numpy()).size <= 64
    assert out["occurrences"].to_pylist()[0][77] == out["presence"].to_pylist()[0][77] == (ids == 77).sum()


def test_sites(spark):
    urls = ["HTTP://WWW.X.example:8080/a", "//x.example", "x.example/b", "https://u:p@www.x.example/", None, "", "www.blog.x.example."]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(lines.site_of(F.col("u")).alias("s"))
    assert [r.s for r in df.collect()] == ["x.example"] * 4 + [None, None, "blog.x.example"]
