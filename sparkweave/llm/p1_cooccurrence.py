"""Problem 1: items that appear together, by basket collapsing.

Identical sets of items are collapsed into one basket with a weight, pairs are enumerated once for each distinct basket,
and the weights are summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators.skew import skew_lookup
from sparkweave.session import materialize
from sparkweave.sources.tables import read_table

#: A basket of more items is cut into segments of so many, whose pairs of segments are spread over tasks.
SEGMENT = 128


def collapse_baskets(rows: DataFrame, group: list[str], item: str) -> DataFrame:
    """``items array<string>`` (sorted, distinct) and ``weight``: how many groups have just these items.

    Rows with a null item or a null part of the group's key belong to no basket; repeated rows count once; an empty
    table gives no rows. Other columns of ``rows`` are not looked at.
    """
    kept = rows.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(item).alias("_item"))
    for c in kept.columns:
        kept = kept.filter(F.col(c).isNotNull())
    baskets = kept.groupBy(*[f"_g{i}" for i in range(len(group))]).agg(F.array_sort(F.collect_set("_item")).alias("items"))
    return baskets.groupBy("items").agg(F.count(F.lit(1)).alias("weight"))


def pair_counts(baskets: DataFrame) -> DataFrame:
    """``key_a < key_b`` and ``n_ab``, the number of baskets that hold both.

    Baskets over ``SEGMENT`` items are enumerated as pairs of segments, each a row of its own, so that no task holds
    all pairs of a large basket.
    """
    small = baskets.filter(F.size("items").between(2, SEGMENT))
    pairs = (
        small.select("items", "weight", F.posexplode("items").alias("_i", "key_a"))
        .select("weight", "key_a", F.explode(F.expr("slice(items, _i + 2, size(items))")).alias("key_b"))
    )
    cut = (
        baskets.filter(F.size("items") > SEGMENT)
        .select("items", "weight", F.explode(F.expr(f"sequence(0, (size(items) - 1) div {SEGMENT})")).alias("_s"))
        .select("items", "weight", "_s", F.explode(F.expr(f"sequence(_s, (size(items) - 1) div {SEGMENT})")).alias("_t"))
        .select("weight", F.expr(f"slice(items, cast(_s * {SEGMENT} + 1 as int), {SEGMENT})").alias("_left"), F.expr(f"slice(items, cast(_t * {SEGMENT} + 1 as int), {SEGMENT})").alias("_right"))
        .repartition(F.xxhash64("_left", "_right"))
        .select("weight", "_right", F.explode("_left").alias("key_a"))
        .select("weight", "key_a", F.explode("_right").alias("key_b"))
        .filter("key_a < key_b")
    )
    return pairs.unionByName(cut).groupBy("key_a", "key_b").agg(F.sum("weight").alias("n_ab"))


def associations(rows: DataFrame, group: list[str], item: str, min_count: int = 5) -> DataFrame:
    """``key_a, key_b, n_ab, n_a, n_b, n, lift, conviction`` of all pairs that meet in ``min_count`` baskets or more.

    ``conviction`` is of the rule key_a -> key_b, null where key_a never stands without key_b.
    """
    baskets = materialize(collapse_baskets(rows, group, item), "p1-baskets")
    n = baskets.agg(F.sum("weight")).first()[0] or 0
    items = baskets.select("weight", F.explode("items").alias("key")).groupBy("key").agg(F.sum("weight").alias("n_key"))
    items = materialize(items, "p1-items")
    out = materialize(pair_counts(baskets).filter(F.col("n_ab") >= min_count), "p1-pairs").withColumn("n", F.lit(n).cast("long"))
    for side, other in ("ab", "ba"):
        # a frequent key has many partners
        degree = out.groupBy(F.col(f"key_{side}").alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
        of_key = materialize(items.join(degree, "key").select(F.col("key").alias(f"key_{side}"), F.col("n_key").alias(f"n_{side}"), "n_rows"), "p1-degrees")
        out = skew_lookup(out, of_key, f"key_{side}", "n_rows", F.col(f"key_{other}"))
    return out.select(
        "key_a", "key_b", "n_ab", "n_a", "n_b", "n",
        F.round(F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b")), 6).alias("lift"),
        F.when(F.col("n_ab") < F.col("n_a"), F.round((1 - F.col("n_b") / F.col("n")) / (1 - F.col("n_ab") / F.col("n_a")), 6)).alias("conviction"),
    )


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "entities").filter(F.col("node_id").isNotNull()).select("chunk_uid", "sent_id", "key")


def p1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return associations(_mentions(spark, sf), ["chunk_uid", "sent_id"], "key")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = associations(_mentions(spark, sf), ["chunk_uid", "sent_id"], "key")
    return pairs.filter("n_ab * n >= 3 * n_a * n_b").select("key_a", "key_b")


_SQL = """
with m as (select distinct chunk_uid, sent_id, key from entities
           where key is not null and node_id is not null and chunk_uid is not null and sent_id is not null),
n as (select count(*) as n from (select distinct chunk_uid, sent_id from m)),
c as (select key, count(*) as n_key from m group by key),
p as (select a.key as key_a, b.key as key_b, count(*) as n_ab from m a join m b
      on a.chunk_uid = b.chunk_uid and a.sent_id = b.sent_id and a.key < b.key group by 1, 2 having count(*) >= 5)
select p.key_a, p.key_b{more} from p join c a on p.key_a = a.key join c b on p.key_b = b.key cross join n{where}
"""
QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs}
ORACLE = {
    "p1_found": _SQL.format(more="", where=" where p.n_ab * n.n >= 3 * a.n_key * b.n_key"),
    "p1_pairs": _SQL.format(
        more=""", p.n_ab, a.n_key as n_a, b.n_key as n_b, n.n as n, round(p.n_ab * n.n / (a.n_key * b.n_key), 6) as lift,
        case when p.n_ab < a.n_key then round((1 - b.n_key / n.n) / (1 - p.n_ab / a.n_key), 6) end as conviction""",
        where="",
    ),
}
