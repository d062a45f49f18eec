"""Exact top-k by inner product: ball-tree branch and bound per shard.

Vectors become integers (``floor(scale * x)``) and are dealt into shards of a
few thousand by a hash of their id; every shard is a ball tree.  Queries come in
groups of a few thousand.  A query goes through a shard's balls in the order of
their upper bound, centre . query + radius * |query|, and stops at the first
ball whose bound is below its current k-th score.

The k-th scores are shared between shards in two steps: each query first
searches one shard (that of its own hash), and takes the k-th score found there
along as the starting bound in all others, so these return only vectors that can
still be among the best.

Defined results: vectors that are null or hold null, NaN or infinite components,
and vectors of another length than the query, take no part; fewer
than k candidates give fewer rows; equal scores go to the smaller id; of rows
with one id none is a candidate of its own id; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

K = 10
SCALE = 1024
SHARD_ROWS = 4096
QUERY_ROWS = 4096
LEAF_ROWS = 128
NO_FLOOR = -(1 << 63)


def integer_vectors(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``_id, _v, _dim``: the valid vectors as integers."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(~bad).select(
        F.col(id_col).cast("long").alias("_id"),
        F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("_v"),
        F.size(vector_col).alias("_dim"))


class BallTree:
    """Leaves of a ball tree over integer vectors: rows in leaf order, centres and radii."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(x))
        points = x.astype(np.float64)
        leaves, todo = [], [(0, len(x))]
        while todo:
            a, b = todo.pop()
            if b - a > leaf_rows:
                rows = self.order[a:b]
                p = points[rows]
                far = p[((p - p.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                other = p[((p - far) ** 2).sum(axis=1).argmax()]
                mid = (b - a) // 2
                self.order[a:b] = rows[np.argsort(p @ (other - far), kind="stable")]
                todo += [(a + mid, b), (a, a + mid)]
            else:
                leaves.append((a, b))
        self.leaves = sorted(leaves)
        self.centre = np.array([points[self.order[a:b]].mean(axis=0) for a, b in self.leaves])
        self.radius = np.array([np.sqrt(((points[self.order[a:b]] - c) ** 2).sum(axis=1).max())
                                for (a, b), c in zip(self.leaves, self.centre)])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of every query (row) with the vectors of every leaf (column)."""
        norm = np.sqrt((q ** 2).sum(axis=1))
        bound = q @ self.centre.T + norm[:, None] * self.radius
        return bound + 1e-9 * (norm[:, None] * (np.abs(self.centre).max(initial=0) * math.sqrt(q.shape[1]) + self.radius) + 1)


def search_shard(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, floor_: np.ndarray, k: int = K,
                 leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and score of the up to ``k`` best vectors per query that reach its ``floor_``."""
    tree = BallTree(x, leaf_rows)
    x, ids = x[tree.order], ids[tree.order]
    # Products are exact in float64 while they stay below 2 ** 53; beyond that, integers.
    largest = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(x.shape[1], 1)
    xs, qs = (x.astype(np.float64), q.astype(np.float64)) if largest < 2 ** 53 else (x, q)
    bounds = tree.bounds(q.astype(np.float64))
    visit = np.argsort(-bounds, axis=1)
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i in range(len(q)):
        kth, best, who = int(floor_[i]), np.zeros(0, xs.dtype), np.zeros(0, np.int64)
        for leaf in visit[i]:
            if bounds[i, leaf] < kth:
                break
            a, b = tree.leaves[leaf]
            score = xs[a:b] @ qs[i]
            ok = (score >= kth) & (ids[a:b] != qids[i])
            if ok.any():
                best, who = np.concatenate((best, score[ok])), np.concatenate((who, ids[a:b][ok]))
                if len(best) > k:
                    top = np.lexsort((who, -best))[:k]
                    best, who = best[top], who[top]
                if len(best) == k:
                    kth = max(kth, int(best.min()))
        out.append((i, who, best))
    n = [len(w) for _, w, _ in out]
    if not sum(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (np.repeat(np.arange(len(q)), n), np.concatenate([w for _, w, _ in out]),
            np.concatenate([b for _, _, b in out]).astype(np.int64))


def _search(k: int, leaf_rows: int):
    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        if not len(vectors) or not len(queries):
            return empty
        x = np.stack([np.asarray(v, np.int64) for v in vectors["_v"]])
        q = np.stack([np.asarray(v, np.int64) for v in queries["_qv"]])
        i, who, score = search_shard(x, vectors["_id"].to_numpy(), q, queries["_qid"].to_numpy(),
                                     queries["_floor"].to_numpy(), k, leaf_rows)
        return pd.DataFrame({"query_id": queries["_qid"].to_numpy()[i], "vec_id": who, "score": score})
    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS,
          query_rows: int = QUERY_ROWS, leaf_rows: int = LEAF_ROWS, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows for every row that ``is_query`` selects.

    Every query meets every shard, as an exact search must; a task holds one
    shard and one group of queries (``shard_rows`` and ``query_rows`` vectors, about).
    """
    rows = store(integer_vectors(vectors, scale, id_col, vector_col), "integer-vectors")
    chosen = store(integer_vectors(vectors.filter(is_query), scale, id_col, vector_col).distinct(), "queries")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    groups = max(1, math.ceil(chosen.count() / query_rows))
    home = F.pmod(F.xxhash64("_id"), F.lit(shards))
    group = F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(groups))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long") - 1))

    placed = rows.select(home.alias("_shard"), every(groups).alias("_group"), "_dim", "_id", "_v")
    asked = chosen.select(home.alias("_home"), group.alias("_qgroup"), F.col("_dim").alias("_qdim"),
                          F.col("_id").alias("_qid"), F.col("_v").alias("_qv"))
    schema = "query_id long, vec_id long, score long"

    def search(queries: DataFrame) -> DataFrame:
        right = queries.select("_qshard", "_qgroup", "_qdim", "_qid", "_qv", "_floor")
        return placed.groupBy("_shard", "_group", "_dim").cogroup(right.groupBy("_qshard", "_qgroup", "_qdim")) \
            .applyInPandas(_search(k, leaf_rows), schema)

    near = store(search(asked.withColumns({"_qshard": F.col("_home"), "_floor": F.lit(NO_FLOOR)})), "home-shards")
    floors = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_min")).select(
        F.col("query_id").alias("_qid"), F.when(F.col("_n") >= k, F.col("_min")).alias("_floor"))
    far = search(asked.join(floors, "_qid", "left").withColumn("_floor", F.coalesce("_floor", F.lit(NO_FLOOR)))
                 .withColumn("_qshard", every(shards)).filter(F.col("_qshard") != F.col("_home")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.unionByName(far).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
