"""Scrubbing, HTML, sentences and chunks against micro-fixtures and plain Python."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sparkweave.functions import html, text
from sparkweave.operators import chunking


def plain_scrub(t: str) -> str:
    t = " ".join(s.strip() for s in t.split("\n")).strip()
    for a, b in (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("`", "'"), ("â", "'"), ("…", "..."), ("–", "-")):
        t = t.replace(a, b)
    return unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()


def test_scrub(spark):
    cases = {
        "  a \n b  ": "a b", "a\n\nb": "a  b", "“x” ‘y’`z": "\"x\" 'y''z", "château": "ch'teau", "wait… 1–2 a—b": "wait... 1-2 ab",
        "café Straße ﬁ ½ ①": "cafe Strae fi 12 1", "\xa0x\xa0": "x", "": "", " \n\t ": "", "ǅ ㎏ ﷺ": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.s for r in df.select("t", text.scrub(F.col("t")).alias("s")).collect()}
    for k, v in cases.items():
        assert got[k] == (plain_scrub(k) if v is None else v) == plain_scrub(k)
    assert got[None] is None


def test_html(spark):
    page = '<html><!-- <p>no</p> --><script>a="</p>"</script><div><p>one <b>two</b> &amp; &lt;x&gt;<p class=q>three</p>no</div><pre>no</pre><p> four&nbsp;</p></html>'
    df = spark.createDataFrame([(page,), ("",), (None,), ("<p>",)], "h string")
    assert [r[0] for r in df.select(html.paragraphs(F.col("h"))).collect()] == [["one two & <x>", "three", "four"], [], None, [""]]


def plain_chunks(lines: list[str], limit: int = 1024) -> list[list[str]]:
    out, now, total, last = [], [], 0, ""
    for s in lines:
        if total + len(s) > limit:
            out.append(now)
            now, total = [last, s], len(last) + len(s)
        else:
            now, total = [*now, s], total + len(s)
        last = s
    return [*out, now]


@pytest.mark.parametrize("sizes", [[], [1024], [1025], [600, 424], [600, 425], [600, 425, 600], [10, 2000, 10]])
def test_chunks(spark, sizes):
    lines = [chr(97 + i) * n for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(lines,)], "l array<string>")
    assert df.select(chunking.fold_chunks(F.col("l"))).first()[0] == plain_chunks(lines)


def test_chunks_random(spark):
    rng = random.Random(3)
    rows = [(i, ["x" * rng.choice([0, 1, 5, 30, 60]) for _ in range(rng.randrange(12))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, l array<string>")
    got = {r[0]: r[1] for r in df.select("i", chunking.fold_chunks(F.col("l"), 64)).collect()}
    assert all(got[i] == plain_chunks(lines, 64) for i, lines in rows)


def test_chunk_numbers(spark):
    docs = spark.createDataFrame([(3, "a. b."), (1, "x " * 900 + ". " + "y " * 900 + "."), (2, None), (5, "")], "doc_id long, text string")
    rows = chunking.number_chunks(chunking.chunk_documents(docs)).orderBy("uid").collect()
    assert [(r.uid, r.doc_id) for r in rows] == list(enumerate(sorted(r.doc_id for r in rows)))
    assert {r.doc_id for r in rows} == {1, 3, 5} and rows[0].node == "chunk_0"


def test_labels(spark):
    df = spark.createDataFrame([(" headquartered in ", "NOUN", " Meat ")], "l string, p string, m string")
    assert tuple(df.select(text.relation_label(F.col("l")), text.lemma_key(F.col("p"), F.col("m"))).first()) == ("HEADQUARTERED_IN", "NOUN.meat")
