"""Chunks, hosts and lines, as the problems on page text use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.sources.tables import read_table


def site_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port, leading ``www.`` and closing dot; null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/:?#]+)", 1)
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    return F.when(host != "", host)


def same_line(line: Column) -> Column:
    """Lower case, runs of space, tab and U+00A0 as one space, trimmed, runs of ASCII digits as ``0``."""
    spaced = F.trim(F.regexp_replace(F.lower(line), "[ \t\u00a0]+", " "))
    return F.regexp_replace(spaced, "[0-9]+", "0")


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``uid, url, text`` of chunks as delivered, repetitions and all; rows with a null uid or text are left out.

    Whatever reads them counts repetitions once by ids and hashes, so that texts aren't shuffled for it.
    """
    return read_table(spark, sf, "text_chunk").select("uid", "url", "text").filter("uid is not null and text is not null")


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """One row a line: the other columns, ``line_no`` from 0, and ``line``."""
    others = [c for c in chunks.columns if c != "text"]
    return chunks.select(*others, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
