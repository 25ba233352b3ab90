"""Joins and dictionaries that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.session import materialize

#: A key is hot from this share of the rows on; so there are at most 1 / HOT_SHARE hot keys, at any size.
HOT_SHARE = 1e-3
SALTS = 64


def skew_lookup(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column, how: str = "inner", sizes: tuple[int, int] | None = None) -> DataFrame:
    """Join ``left`` to ``right``, which has one row per ``key`` and in ``weight`` how many rows ``left`` has of it.

    Rows of hot keys are spread over ``SALTS`` tasks by the hash of ``spread``, and the few hot rows of ``right`` are
    repeated for each salt. The set of hot keys is broadcast; it has at most ``1 / HOT_SHARE`` members. Where there is
    none it is a plain join. Null keys match nothing. ``weight`` isn't in the result. ``sizes`` has its sum and greatest
    value, where they are known.
    """
    total, most = sizes or right.agg(F.sum(weight), F.max(weight)).first()
    least = max(1000.0, (total or 0) * HOT_SHARE)
    if (most or 0) <= least:
        return left.join(right.drop(weight), key, how)
    hot = right.filter(F.col(weight) > least).select(F.col(key).alias("_hot"))
    hot_l = F.broadcast(hot)
    salted_l = left.join(hot_l, left[key] == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    )
    salted_r = right.withColumn(
        "_salt",
        F.explode(F.when(F.col(weight) > least, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))),
    ).drop(weight)
    return salted_l.drop("_hot").join(salted_r, [key, "_salt"], how).drop("_salt")


def dense_dictionary(df: DataFrame, key: str, count: str = "n_rows", out: str = "id", label: str = "dictionary") -> DataFrame:
    """One row per distinct non-null ``key`` with a dense 0-based ``out`` and how many rows of ``df`` have it.

    Numbering needs no global sort: each partition numbers its own keys and an offset per partition, of which there are
    as many as partitions, is added. Ids of one partition are a contiguous range.
    """
    keys = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(count))
    local = materialize(keys.select(key, count, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_local")), label)
    sizes = sorted((r["_part"], r["n"]) for r in local.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, at = [], 0
    for part, n in sizes:
        offsets.append((part, at))
        at += n
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _offset long")
    return local.join(F.broadcast(table), "_part").select(key, (F.col("_local") + F.col("_offset")).alias(out), count)
