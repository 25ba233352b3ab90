"""Problem 4: frequency of every distinct value, by a dictionary and blockwise count arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators.skew import dense_dictionary, skew_lookup
from sparkweave.session import materialize
from sparkweave.sources.tables import read_table

#: Identifiers in a block, and parts of a block's identifiers that are counted apart, so that no task gets all its rows.
BLOCK, PARTS = 1024, 4
_BLOCKS = "block long, occurrences array<long>, presence array<long>"


def _presummed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one identifier in a batch as one, so that a hot one costs a row a batch."""
    for batch in batches:
        ids, which, n = np.unique(batch.column(0).to_numpy(), return_inverse=True, return_counts=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, which, batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(ids // BLOCK), pa.array(ids), pa.array(total), pa.array(n)], ["block", "id", "n", "records"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pair of arrays for each block; rows come sorted by block, so a task holds one at a time."""
    now, held = None, np.zeros((2, BLOCK), np.int64)

    def out(blocks: list[int], arrays: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *(pa.array([a[i] for a in arrays], pa.list_(pa.int64())) for i in (0, 1))], ["block", "occurrences", "presence"])

    for batch in batches:
        block, ids, n, records = (c.to_numpy() for c in batch.columns)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
        blocks, arrays = [], []
        for b, i, j in zip(block[starts].tolist(), starts, [*starts[1:], len(block)]):
            if b != now:
                if now is not None:
                    blocks.append(now)
                    arrays.append(held)
                now, held = b, np.zeros((2, BLOCK), np.int64)
            np.add.at(held[0], ids[i:j] - b * BLOCK, n[i:j])
            np.add.at(held[1], ids[i:j] - b * BLOCK, records[i:j])
        if blocks:
            yield out(blocks, arrays)
    if now is not None:
        yield out([now], [held])


def _summed(blocks: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"block": [blocks["block"].iloc[0]], **{c: [np.sum(np.stack(blocks[c].to_list()), axis=0)] for c in ("occurrences", "presence")}})


def frequencies(mentions: DataFrame, key: str, record: str, rare: int = 1, common_share: float = 0.1) -> DataFrame:
    """``key, n_occurrences, n_records, mark`` of each non-null key of ``mentions``, one row a mention.

    ``mark`` is ``rare`` for a key of at most ``rare`` records, else ``common`` for one in more than ``common_share`` of
    the records that have any key, else null. A null record counts as one record. An empty table gives no rows.
    Mentions are first summed by key and record on the map side. Encoded rows are summed by batch, brought together by
    range of identifiers and counted into the arrays of one block after the other; the arrays of a block's parts are summed.
    """
    held = mentions.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), F.col(record).alias("record")).agg(F.count(F.lit(1)).alias("n"))
    held = materialize(held, "p4-held")
    records = held.select(F.countDistinct(F.coalesce(F.col("record").cast("string"), F.lit("")))).first()[0]
    words = materialize(dense_dictionary(held, "key", label="p4-keys"), "p4-dictionary")
    encoded = skew_lookup(held, words, "key", "n_rows", F.col("record")).select("id", "n")
    parts = encoded.mapInArrow(_presummed, "block long, id long, n long, records long").repartition("block", F.pmod("id", F.lit(PARTS))).sortWithinPartitions("block")
    blocks = parts.mapInArrow(_arrays, _BLOCKS).groupBy("block").applyInPandas(_summed, _BLOCKS)
    counts = blocks.select("block", F.posexplode(F.arrays_zip("occurrences", "presence")).alias("at", "c")).select(
        (F.col("block") * BLOCK + F.col("at")).alias("id"), F.col("c.occurrences").alias("n_occurrences"), F.col("c.presence").alias("n_records")
    ).filter("n_records > 0")
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > records * common_share, "common")
    return counts.join(words.drop("n_rows"), "id").select(F.col("key"), "n_occurrences", "n_records", mark.alias("mark"))


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    """A mention is named by its chunk and span, and a repeated delivery has the same key."""
    return read_table(spark, sf, "entities").filter("key is not null").select("chunk_uid", "span_start", "span_end", "key").distinct()


def p4_terms(spark: SparkSession, sf: str) -> DataFrame:
    return frequencies(_mentions(spark, sf), "key", "chunk_uid")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return frequencies(_mentions(spark, sf), "key", "chunk_uid").filter("mark is not null").select("key", "mark")


_SQL = """
with m as (select distinct chunk_uid, span_start, span_end, key from entities where key is not null),
t as (select key, count(*) as n_occurrences, count(distinct coalesce(cast(chunk_uid as varchar), '')) as n_records from m group by key),
c as (select count(distinct coalesce(cast(chunk_uid as varchar), '')) as c from m)
select key{more}, case when n_records <= 1 then 'rare' when n_records > c * 0.1 then 'common' end as mark from t cross join c{where}
"""
QUERIES = {"p4_found": p4_found, "p4_terms": p4_terms}
ORACLE = {
    "p4_found": _SQL.format(more="", where=" where n_records <= 1 or n_records > c * 0.1"),
    "p4_terms": _SQL.format(more=", n_occurrences, n_records", where=""),
}
