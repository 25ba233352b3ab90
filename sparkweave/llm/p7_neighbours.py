"""Problem 7: the most similar vectors of every vector, by a block matrix join in int8 with error bounds.

Vectors fall into cells around centres, of which there are two levels beyond some thousands; each is compared with those
of its nearest cells, as many as a trial with exact answers asks for, in tiles of bounded size.
In a tile the products of int8 vectors give similarities with an error bound; pairs that may be among the best are
computed again in float64, and the best of all tiles are merged by heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators.skew import skew_lookup
from sparkweave.session import materialize
from sparkweave.sources.tables import read_table

DIM, K = 64, 5
#: Vectors that a cell holds on average, the fewest and the most cells searched for each vector, and the most centres of a level.
CELL, PROBES, MOST_PROBES, MAX_CENTRES = 1600, 4, 256, 4096
#: The centres are fitted on this many vectors a cell, and no more than the bound in all.
SAMPLE_PER_CELL, MAX_SAMPLE = 256, 65536
#: Vectors whose neighbours are found exactly to choose the number of cells searched, and the share of neighbours to be found.
TRIED, WANTED = 256, 0.98
#: Rows of a tile: vectors searched in, and vectors that search.
TILE, SEARCHERS = 4096, 8192


def usable(vector: Column, dim: int = DIM) -> Column:
    """A vector of ``dim`` finite values, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else tiny values vanish when squared
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _means(x: np.ndarray, k: int, rounds: int, unit: bool) -> np.ndarray:
    """k-means from evenly spaced rows; with ``unit`` spherical."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds if k > 1 else 1):
        half = 0 if unit else (centres * centres).sum(axis=1) / 2
        at = np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(at, kind="stable")
        cells, first = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        centres[cells] = sums if unit else sums / np.diff(np.append(first, len(x)))[:, None]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


class Cells:
    """Cells around unit centres; beyond ``most`` of them around sums of a centre and a second one, fitted on what the
    first ones leave over, so that ``most`` squared cells need twice ``most`` centres. A cell is a number."""

    def __init__(self, x: np.ndarray, k: int, most: int = MAX_CENTRES, rounds: int = 12) -> None:
        first = k if k <= most else int(min(most, np.ceil(np.sqrt(k))))
        self.first = _means(x, min(first, len(x)), rounds, True)
        self.second = np.zeros((1, x.shape[1]), np.float32)
        if k > most:
            left = x - self.first[np.concatenate([(x[i : i + 4096] @ self.first.T).argmax(axis=1) for i in range(0, len(x), 4096)])]
            self.second = _means(left, int(min(most, -(-k // len(self.first)), len(x))), rounds, False)
        self.size = len(self.first) * len(self.second)
        self.length = np.sqrt(np.maximum((self.first * self.first).sum(axis=1)[:, None] + 2 * self.first @ self.second.T + (self.second * self.second).sum(axis=1)[None, :], 1e-12)).astype(np.float32)

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Of each row the numbers of its nearest cells, the best one first."""
        probes, out = min(probes, self.size), []
        # only cells of a row's nearest first centres can be near
        tops = min(len(self.first), max(8, 2 * probes)) if len(self.second) > 1 else len(self.first)
        step = max(1, min(1024, 4_000_000 // (tops * len(self.second))))
        for i in range(0, len(x), step):
            part = x[i : i + step]
            near = part @ self.first.T
            top = np.argpartition(-near, tops - 1, axis=1)[:, :tops] if tops < near.shape[1] else np.broadcast_to(np.arange(tops), near.shape)
            score = ((np.take_along_axis(near, top, axis=1)[:, :, None] + (part @ self.second.T)[:, None, :]) / self.length[top]).reshape(len(part), -1)
            number = (top[:, :, None] * len(self.second) + np.arange(len(self.second))).reshape(len(part), -1)
            if probes < score.shape[1]:
                kept = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
                score, number = np.take_along_axis(score, kept, axis=1), np.take_along_axis(number, kept, axis=1)
            out.append(np.take_along_axis(number, np.lexsort((number, -score), axis=1), axis=1))
        return np.concatenate(out).astype(np.int32)


def sample(vectors: DataFrame, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the ``size`` rows of least hash, whatever the partitions.

    A threshold on the hash leaves few more rows than are taken, so that no task gets what it doesn't keep.
    """
    h = F.pmod(F.xxhash64("uid"), F.lit(1 << 40))
    share = min(1.0, 1.3 * (size + 50) / max(n, 1))
    rows = vectors.filter(h < int(share * (1 << 40))).orderBy(h, "uid").limit(size).select("uid", "vector").toArrow()
    return rows["uid"].to_numpy(), _unit(_matrix(rows["vector"])).astype(np.float32) if rows.num_rows else np.zeros((0, DIM), np.float32)


def _scanner(who: np.ndarray, x: np.ndarray, k: int):
    """The ``k`` vectors of a task most similar to each of some others, by brute force."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros((len(x), 0), np.float32), np.zeros((len(x), 0), np.int64)]
        held = np.zeros((len(x), 0, x.shape[1]), np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            uid, raw = batch.column(0).to_numpy(), _matrix(batch.column(1))
            s = x @ _unit(raw).astype(np.float32).T
            s[who[:, None] == uid[None, :]] = -4
            s, ids = np.concatenate([best[0], s], axis=1), np.concatenate([best[1], np.broadcast_to(uid, s.shape)], axis=1)
            at = np.argsort(-s, axis=1, kind="stable")[:, :k]
            old = held.shape[1]
            fresh = raw[np.maximum(at - old, 0)]
            held = np.where((at < old)[:, :, None], np.take_along_axis(held, np.minimum(at, old - 1)[:, :, None], axis=1), fresh) if old else fresh
            best = [np.take_along_axis(s, at, axis=1), np.take_along_axis(ids, at, axis=1)]
        q, j = np.nonzero(best[0] > -3)
        vectors = pa.ListArray.from_arrays(np.arange(0, len(q) * x.shape[1] + 1, x.shape[1], dtype=np.int32), held[q, j].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(best[1][q, j]), pa.array(best[0][q, j].astype(np.float64)), vectors], ["q", "uid", "cosine", "vector"])

    return run


def tried_probes(vectors: DataFrame, cells: Cells, who: np.ndarray, x: np.ndarray, k: int, fewest: int, wanted: float = WANTED) -> int:
    """How many cells have to be searched to find the ``wanted`` share of the ``k`` nearest of some vectors, which are found exactly."""
    if cells.size <= fewest or not len(who):
        return min(cells.size, fewest)
    each = vectors.select("uid", "vector").mapInArrow(_scanner(who, x, k), "q int, uid long, cosine double, vector array<float>")
    best = each.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "uid", "vector"))), 1, k).alias("b")).select("q", F.explode("b.vector").alias("v")).toArrow()
    if not best.num_rows:
        return fewest
    most = min(cells.size, MOST_PROBES)
    order = cells.nearest(x, most)
    home = cells.nearest(_unit(_matrix(best["v"])).astype(np.float32), 1)[:, 0]
    hit = order[best["q"].to_numpy()] == home[:, None]
    rank = np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, most)
    return int(max(fewest, np.sort(rank)[int(np.ceil(wanted * len(rank))) - 1]))


def _assigner(cells: Cells, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _matrix(batch.column(1))
            near = cells.nearest(_unit(raw).astype(np.float32), probes)
            lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), near.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in raw], pa.binary()), lists], ["uid", "raw", "cells"])

    return run


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as float32, in which their products are exact), scales, and the length of what rounding took."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127.0
    q = np.rint(x / scale)
    return q.astype(np.float32), scale[:, 0], np.linalg.norm(x - q * scale, axis=1)


def _tile(k: int):
    def run(rows: pa.Table) -> pa.Table:
        asks = rows["asks"].to_numpy().astype(bool)
        uid = rows["uid"].to_numpy()
        x = _unit(np.frombuffer(b"".join(rows["raw"].to_pylist()), np.float32).reshape(len(uid), -1))
        order = np.argsort(uid[~asks], kind="stable")
        data, ids = x[~asks][order], uid[~asks][order]
        dq, ds, de = _quantised(data)
        query, who = x[asks], uid[asks]
        qq, qs, qe = _quantised(query)
        out_q, out_d, out_s = [], [], []
        for i in range(0, len(who) if len(ids) else 0, 512):
            j = min(i + 512, len(who))
            approx = (qq[i:j] @ dq.T) * (qs[i:j, None] * ds[None, :]).astype(np.float32)
            error = (qe[i:j, None] * (1 + de[None, :]) + de[None, :] + 1e-5).astype(np.float32)
            own = np.searchsorted(ids, who[i:j])
            hit = (own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == who[i:j])
            approx[np.flatnonzero(hit), own[hit]] = -4
            low = approx - error
            if low.shape[1] > k:
                least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
            else:
                least = np.full(j - i, -2.0, np.float32)
            r, c = np.nonzero((approx + error >= least[:, None]) & (approx > -3))
            exact = np.einsum("ij,ij->i", query[i + r], data[c])
            best = np.lexsort((ids[c], -exact, r))
            r, c, exact = r[best], c[best], exact[best]
            rank = np.arange(len(r)) - np.searchsorted(r, r, side="left")
            kept = rank < k
            out_q.append(who[i + r[kept]])
            out_d.append(ids[c[kept]])
            out_s.append(exact[kept])
        cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else np.array([], t))
        return pa.table({"uid": cat(out_q, np.int64), "other": cat(out_d, np.int64), "cosine": cat(out_s, np.float64)})

    return run


def _placer(data_parts: dict[int, int], query_parts: dict[int, int]):
    """Rows of tiles: a vector once for each part of the searchers of its cell, and as searcher in each cell near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, cells = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            row, tile, asks = [], [], []
            for i, (uid, near) in enumerate(zip(uids, cells)):
                h = (uid * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 20
                for at, c in enumerate(near):
                    nd, nq = data_parts.get(c, 1), query_parts.get(c, 1)
                    if not at:
                        row += [i] * nq
                        tile += [f"{c}/{h % nd}/{q}" for q in range(nq)]
                        asks += [0] * nq
                    row += [i] * nd
                    tile += [f"{c}/{d}/{h % nq}" for d in range(nd)]
                    asks += [1] * nd
            taken = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(tile, pa.string()), pa.array(asks, pa.int8()), batch.column(0).take(taken), batch.column(1).take(taken)], ["tile", "asks", "uid", "raw"])

    return run


def _merge_batches(k: int):
    """Merges the lists of many searchers at once; all rows of one come in one partition, sorted by searcher."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple[float, int]] = []
        now, uids, lists = None, [], []

        def close() -> None:
            if now is not None:
                uids.append(now)
                lists.append([{"cosine": c, "other": -o} for c, o in sorted(heap, reverse=True)])

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(lists, pa.list_(pa.struct([("cosine", pa.float64()), ("other", pa.int64())])))], ["uid", "near"])

        for batch in batches:
            for uid, other, cosine in zip(*(c.to_pylist() for c in batch.columns)):
                if uid != now:
                    close()
                    now, heap = uid, []
                item = (cosine, -other)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            if len(uids) > 5000:
                yield out()
                uids.clear()
                lists.clear()
        close()
        yield out()

    return run


def nearest(vectors: DataFrame, k: int = K, cell: int = CELL, probes: int = PROBES, most: int = MAX_CENTRES) -> DataFrame:
    """``uid, near``: of each of the different ``vectors`` (``uid, vector``) the up to ``k`` most similar others, best first.

    ``probes`` cells are searched for each, or more where a trial shows that fewer would miss over 2 % of the neighbours.
    """
    n = vectors.count()
    empty = "uid long, near array<struct<cosine:double,other:long>>"
    if not n:
        return vectors.sparkSession.createDataFrame([], empty)
    wanted = max(1, -(-n // cell))
    who, x = sample(vectors, n, min(MAX_SAMPLE, SAMPLE_PER_CELL * wanted))
    cells = Cells(x, wanted, most)
    searched = tried_probes(vectors, cells, who[:TRIED], x[:TRIED], k, probes)
    placed = materialize(vectors.mapInArrow(_assigner(cells, searched), "uid long, raw binary, cells array<int>"), "p7-placed")
    # only cells that are too large for one tile are told apart
    sizes = lambda c, least: {r["cell"]: r["n"] for r in placed.select(c.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).collect()}
    held, asked = sizes(F.col("cells")[0], TILE), sizes(F.explode("cells"), SEARCHERS)
    data_parts = {c: -(-m // TILE) for c, m in held.items()}
    query_parts = {c: -(-m // SEARCHERS) for c, m in asked.items()}
    rows = placed.mapInArrow(_placer(data_parts, query_parts), "tile string, asks byte, uid long, raw binary")
    found = rows.groupBy("tile").applyInArrow(_tile(k), "uid long, other long, cosine double")
    together = found.repartition("uid").sortWithinPartitions("uid")
    return together.mapInArrow(_merge_batches(k), empty)


def neighbours(rows: DataFrame, id_col: str, vector_col: str, k: int = K, dim: int = DIM, cell: int = CELL, probes: int = PROBES, most: int = MAX_CENTRES) -> DataFrame:
    """``uid, near``: of each id with a usable vector the ``k`` most similar others by cosine, equal ones by smaller id.

    Of several vectors of one id the largest is taken. Null, short, zero and not finite vectors and null ids are left
    out; a table without usable vectors gives no rows. Equal vectors are searched for once, as one class, whose
    members then stand first in each other's list; a class may hold any share of the rows.
    """
    found = rows.select(F.col(id_col).cast("long").alias("uid"), F.col(vector_col).cast("array<float>").alias("vector")).filter(F.col("uid").isNotNull() & usable(F.col("vector"), dim))
    each = materialize(found.groupBy("uid").agg(F.max("vector").alias("vector")), "p7-vectors")
    keyed = each.select("uid", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    classes = materialize(keyed.groupBy("h1", "h2").agg(F.min("uid").alias("cid"), F.count(F.lit(1)).alias("n")), "p7-classes")
    first = each.join(classes.select(F.col("cid").alias("uid")), "uid", "left_semi")
    near = materialize(nearest(first, k, cell, probes, most), "p7-near")
    copies = classes.filter("n > 1")
    members = materialize(skew_lookup(keyed, copies.select("h1", F.col("h2").alias("_h2"), "cid", "n"), "h1", "n", F.col("uid")).filter("h2 = _h2").select("uid", "cid"), "p7-copies")
    if members.isEmpty():
        return near
    by_salt = members.selectExpr("uid", "cid", "row_number() over (partition by cid, pmod(xxhash64(uid), 64) order by uid) as r").filter(F.col("r") <= k + 1)
    firsts = by_salt.selectExpr("uid as member", "cid as other", "row_number() over (partition by cid order by uid) as r").filter(F.col("r") <= k + 1).drop("r")
    lists = near.select("uid", F.explode("near").alias("x")).select("uid", "x.cosine", "x.other")
    own = copies.select(F.col("cid").alias("uid"), F.lit(1.0).alias("cosine"), F.col("cid").alias("other"))
    full = lists.unionByName(own).join(firsts, "other", "left").select("uid", F.struct((-F.col("cosine")).alias("c"), F.coalesce("member", "other").alias("o")).alias("x"))
    best = full.groupBy("uid").agg(F.slice(F.array_sort(F.collect_set("x")), 1, k + 1).alias("all"))
    best = materialize(best.join(copies.select(F.col("cid").alias("uid"), "n"), "uid", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumnRenamed("uid", "cid"), "p7-best")
    who = classes.filter("n = 1").select(F.col("cid").alias("uid"), "cid").unionByName(members)
    joined = skew_lookup(who, best, "cid", "n", F.col("uid"))
    chosen = F.slice(F.filter("all", lambda x: x["o"] != F.col("uid")), 1, k)
    return joined.select("uid", F.transform(chosen, lambda x: F.struct((-x["c"]).alias("cosine"), x["o"].alias("other"))).alias("near"))


def _near(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours(read_table(spark, sf, "text_chunk"), "uid", "vector")


def p7_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf).select("uid", F.posexplode("near").alias("rank", "x")).select("uid", "rank", F.col("x.other").alias("neighbour"), F.round("x.cosine", 5).alias("cosine"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _near(spark, sf).select("uid", F.explode("near.other").alias("other"))
    return pairs.select(F.least("uid", "other").alias("uid_a"), F.greatest("uid", "other").alias("uid_b")).distinct()


_SQL = """
with u as (select uid, max(vector) as v from text_chunk where uid is not null and len(vector) = 64
           and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by uid),
d as (select uid, cast(v as double[64]) as v from u),
p as (select a.uid, b.uid as neighbour, array_cosine_similarity(a.v, b.v) as cosine from d a join d b on a.uid <> b.uid),
r as (select *, row_number() over (partition by uid order by cosine desc, neighbour) as rank from p qualify rank <= 5)
"""
QUERIES = {"p7_found": p7_found, "p7_neighbours": p7_neighbours}
ORACLE = {
    "p7_found": _SQL + "select distinct least(uid, neighbour) as uid_a, greatest(uid, neighbour) as uid_b from r",
    "p7_neighbours": _SQL + "select uid, cast(rank - 1 as integer) as rank, neighbour, round(cosine, 5) as cosine from r",
}
