"""Nearest neighbours with a vantage-point tree per shard.

Every vector goes into one shard of about ``SHARD_ROWS``; each shard's tree
is built in one task and written as one row (points in tree order, nodes as
(vantage point, ranges, largest inner and smallest outer distance)). A query
meets every shard: it first descends to its own leaf, which bounds its k-th
distance, then the tree is walked once for all queries of the task, a node
being entered by the queries whose triangle-inequality bound, times
``factor``, does not exceed their k-th distance. ``factor`` 1 is exact
search; larger factors prune more. The shards' best are merged per query.

Scale: queries are a stated set; they are sent to the shards in parts of
about ``PART_QUERIES``, so a task holds one tree and one part. The merge
sees k rows per shard and query.

Defined results: rows with a null id, and vectors that are null, empty, zero
or hold null or non-finite components, take no part; vectors are compared
with those of their own length; equal distances go to the smaller vec_id;
rows that share the query's vec_id are its own; a repeated candidate row is a
candidate each time; a repeated query row is asked once (its smallest
vector); fewer candidates than k give them all; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskshift.llm.common import materialize

SHARD_ROWS = 8192
PART_QUERIES = 1 << 16
QUERIES_AT_ONCE = 1024
LEAF = 128
K = 10


def usable(vector: str) -> Column:
    """The vector has components, all of them finite numbers and not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a (double) to all of b, components added in order."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        total += d * d
    return np.sqrt(total)


def build(points: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, node ranges (lo, mid, hi, inner child, outer child) and node bounds (inner max, outer min).

    A leaf has mid = -1. The vantage point of a node stands at ``lo``, the
    inner half in [lo + 1, mid), the outer in [mid, hi).
    """
    rng, order = np.random.default_rng(seed), np.arange(len(points))
    nodes, bounds, todo = [], [], [(0, len(points), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = me
        if hi - lo <= LEAF:
            nodes.append([lo, -1, hi, -1, -1])
            bounds.append((0.0, 0.0))
            continue
        pick = int(rng.integers(lo, hi))
        order[[lo, pick]] = order[[pick, lo]]
        rest = order[lo + 1:hi]
        d = distances(points[order[lo:lo + 1]], points[rest])[0]
        half = len(rest) // 2
        by = np.argpartition(d, half)
        order[lo + 1:hi] = rest[by]
        nodes.append([lo, lo + 1 + half, hi, -1, -1])
        bounds.append((d[by[:half]].max(), d[by[half:]].min()))
        todo += [(lo + 1, lo + 1 + half, me, 0), (lo + 1 + half, hi, me, 1)]
    return order, np.array(nodes, np.int64), np.array(bounds)


class Search:
    """k best points of one tree for a block of queries."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, nodes: np.ndarray, bounds: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.ids, self.points, self.nodes, self.bounds = ids, points, nodes, bounds
        self.qids, self.queries, self.factor = qids, queries, factor
        self.best = np.full((len(qids), k), np.inf)
        self.who = np.full((len(qids), k), np.iinfo(np.int64).max)
        self.seen = np.full(len(qids), -1)     # the leaf a query has been through

    def meet(self, q: np.ndarray, lo: int, hi: int, d: np.ndarray | None = None) -> None:
        """Merge points [lo, hi) into the best of queries q."""
        d = distances(self.queries[q], self.points[lo:hi]) if d is None else d
        ids = np.broadcast_to(self.ids[lo:hi], d.shape)
        d = np.where(ids == self.qids[q][:, None], np.inf, d)
        d, ids = np.concatenate([self.best[q], d], 1), np.concatenate([self.who[q], ids], 1)
        order = np.lexsort((ids, d), axis=1)[:, :self.best.shape[1]]
        self.best[q], self.who[q] = np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)

    def descend(self) -> None:
        todo = [(0, np.arange(len(self.qids)))]
        while todo:
            node, q = todo.pop()
            lo, mid, hi, inner, outer = self.nodes[node]
            if not len(q):
                continue
            if mid < 0:
                self.meet(q, lo, hi)
                self.seen[q] = node
                continue
            d = distances(self.queries[q], self.points[lo:lo + 1])[:, 0]
            near = d <= self.bounds[node].mean()
            todo += [(inner, q[near]), (outer, q[~near])]

    def walk(self) -> None:
        todo = [(0, np.arange(len(self.qids)), np.zeros(len(self.qids)))]
        while todo:
            node, q, least = todo.pop()
            open_ = self.factor * least <= self.best[q, -1] * (1 + 1e-9) + 1e-12   # room for rounding
            q, least = q[open_], least[open_]
            if not len(q):
                continue
            lo, mid, hi, inner, outer = self.nodes[node]
            if mid < 0:
                q = q[self.seen[q] != node]
                if len(q):
                    self.meet(q, lo, hi)
                continue
            d = distances(self.queries[q], self.points[lo:lo + 1])
            self.meet(q, lo, lo + 1, d)
            inner_max, outer_min = self.bounds[node]
            todo += [(outer, q, np.maximum(least, outer_min - d[:, 0])), (inner, q, np.maximum(least, d[:, 0] - inner_max))]

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.descend()
        self.walk()
        found = np.isfinite(self.best)
        return np.repeat(self.qids, found.sum(1)), self.who[found], self.best[found]


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return (np.concatenate(parts) if parts else np.empty(0)).astype(np.float64).reshape(-1, dim)


def index(vectors: DataFrame) -> DataFrame:
    """One row per shard: its tree over all the shard's vectors. ``vectors``: vec_id, v (array of double), dim, shard."""

    def run(table: pa.Table) -> pa.Table:
        dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
        order = np.argsort(np.array(table["vec_id"]), kind="stable")
        ids, points = np.array(table["vec_id"])[order], matrix(table["v"], dim)[order]
        order, nodes, bounds = build(points)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int64()), "ids": [ids[order].tobytes()],
                         "points": [points[order].tobytes()], "nodes": [nodes.tobytes()], "bounds": [bounds.tobytes()]})

    return vectors.groupBy("dim", "shard").applyInArrow(run, "dim int, shard bigint, ids binary, points binary, nodes binary, bounds binary")


def nearest(vectors: DataFrame, queries: Column, k: int = K, factor: float = 1.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of every row for which ``queries`` holds."""
    v = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable("embedding"))
    v = v.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim"))
    asked = v.where(queries).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    n, n_asked = v.count(), asked.count()
    upto = lambda m: F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))
    shards, parts = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_asked // PART_QUERIES))
    placed = v.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)))
    trees = materialize(index(placed), "vp-trees")
    trees = trees.withColumn("part", F.explode(upto(parts)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    asked = asked.withColumn("shard", F.explode(upto(shards)))

    def run(tree: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(tree) and len(asked):
            t = tree.slice(0, 1).to_pylist()[0]
            dim = t["dim"]
            ids, points = np.frombuffer(t["ids"], np.int64), np.frombuffer(t["points"]).reshape(-1, dim)
            nodes, bounds = np.frombuffer(t["nodes"], np.int64).reshape(-1, 5), np.frombuffer(t["bounds"]).reshape(-1, 2)
            qids, q = np.array(asked["vec_id"]), matrix(asked["v"], dim)
            for a in range(0, len(qids), QUERIES_AT_ONCE):
                out.append(Search(ids, points, nodes, bounds, qids[a:a + QUERIES_AT_ONCE], q[a:a + QUERIES_AT_ONCE], k, factor).run())
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0)] * 3
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    key = ["dim", "shard", "part"]
    found = trees.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
