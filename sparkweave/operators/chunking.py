"""Sentences and overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.functions.text import scrub_all
from sparkweave.session import materialize

CHUNK_SIZE = 1024
_STATE = "struct<done:array<array<string>>,now:array<string>,total:int,last:string>"


def sentences(text: Column) -> Column:
    """``array<string>``: the text cut at white space after a full stop, question or exclamation mark."""
    return F.split(text, r"(?<=[.!?])[ \t\n\r\f]+")


def fold_chunks(lines: Column, limit: int = CHUNK_SIZE) -> Column:
    """``array<array<string>>``: lines packed into chunks; a chunk begins with the last line of the one before.

    A chunk is closed when the next line would bring it over ``limit`` characters, line feeds not counted. A first line
    over the limit leaves an empty first chunk; no lines at all give one empty chunk.
    """
    start = F.struct(F.array().alias("done"), F.array().alias("now"), F.lit(0).alias("total"), F.lit("").alias("last")).cast(_STATE)

    def step(acc: Column, line: Column) -> Column:
        full = acc["total"] + F.length(line) > limit
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(acc["last"], line)).otherwise(F.concat(acc["now"], F.array(line))).alias("now"),
            (F.when(full, F.length(acc["last"])).otherwise(acc["total"]) + F.length(line)).alias("total"),
            line.alias("last"),
        ).cast(_STATE)

    return F.aggregate(lines, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))


def chunk_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = CHUNK_SIZE) -> DataFrame:
    """``doc_id, pos, text``: scrubbed sentences of each document in overlapping chunks; a null text gives none."""
    lines = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), scrub_all(sentences(F.col(text))).alias("_sentences"))
    return lines.select("doc_id", F.posexplode(fold_chunks(F.col("_sentences"), limit)).alias("pos", "_lines")).select("doc_id", "pos", F.array_join("_lines", "\n").alias("text"))


def number_chunks(chunks: DataFrame) -> DataFrame:
    """Adds ``uid``, dense over all documents in their order, and ``node``: its id in the overlay.

    Counts per document are summed over ranges of documents, so no task sees them all: each range numbers its own and
    adds the sum of the ranges before.
    """
    per = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    held = materialize(per.withColumn("part", F.spark_partition_id()), "chunk-counts")
    at, offsets = 0, []
    for r in sorted(held.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["part"]):
        offsets.append((r["part"], at))
        at += r["n"]
    table = chunks.sparkSession.createDataFrame(offsets or [(0, 0)], "part int, base long")
    before = held.join(F.broadcast(table), "part").selectExpr("doc_id", "base + sum(n) over (partition by part order by doc_id) - n as base")
    return chunks.join(before, "doc_id").withColumn("uid", F.col("base") + F.col("pos")).withColumn("node", F.concat(F.lit("chunk_"), F.col("uid").cast("string"))).drop("base")
