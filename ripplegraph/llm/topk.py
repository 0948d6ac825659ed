"""Exact top-k search by inner product with a KD-tree per shard.

Vectors become whole numbers, floor(256 x).  Rows are dealt to shards by a hash of their id; a shard
builds a KD-tree by median splits on its widest dimension and keeps a tight box per node.  A query
visits nodes best first by the bound of its box, max over the box of q.x = sum of
max(q_i lo_i, q_i hi_i), and stops when the bound falls below its k-th score.  It searches its own
shard first; that k-th score then travels with it to the other shards, where it prunes from the start.

Queries are stated by a condition on their ids and meet all rows in blocks: a task holds a block of
queries and a shard, both of bounded size, and gives at most k rows per query.  Scores are exact
integers; ties go to the smaller id, so nodes whose bound equals the k-th score are visited.

Vectors that are null, empty, or hold null or non-finite components take no part; vectors of another
length than the query's are no candidates.  Repeated ids are candidates each; a query meets no row of
its own id.  A null id takes no part.  Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.session import materialize

LEAF = 64


class Tree:
    """Median-split tree over rows of whole numbers, with tight boxes."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(ids))
        nodes: list[tuple[int, int, int, int]] = []  # first, last, left child, right child
        lo, hi = [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = points[order[a:b]]
            me = len(nodes)
            low, high = own.min(axis=0), own.max(axis=0)
            lo.append(low)
            hi.append(high)
            nodes.append((a, b, -1, -1))
            if parent >= 0:
                p = nodes[parent]
                nodes[parent] = (p[0], p[1], me, p[3]) if side == 0 else (p[0], p[1], p[2], me)
            wide = int(np.argmax(high - low))
            if b - a > leaf and high[wide] > low[wide]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide], mid)]
                todo += [(a + mid, b, me, 1), (a, a + mid, me, 0)]
        self.nodes, self.lo, self.hi = nodes, np.stack(lo), np.stack(hi)
        self.points, self.ids = points[order], ids[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest possible score of each query in each node's box."""
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, id) whose score is at least ``floor``."""
        best: list[tuple[int, int]] = []  # (score, -id), smallest first
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < floor:
                break
            a, b, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            scores = self.points[a:b] @ query
            near = np.flatnonzero((scores >= floor) & (self.ids[a:b] != own))
            if len(near) > k:  # the k best of a leaf by score, then id
                near = near[np.lexsort((self.ids[a:b][near], -scores[near]))[:k]]
            for i in near:
                heapq.heappush(best, (int(scores[i]), -int(self.ids[a + i])))
                if len(best) > k:
                    heapq.heappop(best)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(s, -v) for s, v in best]


def quantised(vectors: DataFrame, ids: str, vector: str) -> DataFrame:
    """(vec_id, v) with v = floor(256 x), without vectors that take no part."""
    x = F.col(vector)
    ok = x.isNotNull() & (F.size(x) > 0) & F.col(ids).isNotNull()
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.filter(ok & F.coalesce(finite, F.lit(False))).select(F.col(ids).cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("bigint")).alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    m = np.stack(column.to_list()).astype(np.int64)
    # products of doubles are exact, and faster, while every sum stays below 2**53
    return m.astype(np.float64) if m.shape[1] * float(np.abs(m).max(initial=0)) ** 2 < 2**52 else m


def _search_block(points: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out: list[tuple[int, int, int]] = []
    if len(points) and len(queries):
        both = _matrix(pd.concat([points["v"], queries["v"]]))
        tree = Tree(both[: len(points)], points["vec_id"].to_numpy())
        asked = both[len(points) :]
        floors = queries["floor"].fillna(-np.inf).to_numpy()
        for at in range(0, len(queries), 256):
            bounds = tree.bounds(asked[at : at + 256])
            for i, b in enumerate(bounds, at):
                q = int(queries["query_id"].iloc[i])
                out += [(q, s, v) for s, v in tree.search(asked[i], q, b, k, floors[i])]
    return pd.DataFrame(out, columns=["query_id", "score", "vec_id"]).astype("int64")


def _meet(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Partial results of blocks: points and queries meet where shard, block and length are equal."""
    keys = ["shard", "block", "dim"]
    return points.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(lambda p, q: _search_block(p, q, k), "query_id bigint, score bigint, vec_id bigint")


def search(vectors: DataFrame, is_query, ids: str = "vec_id", vector: str = "embedding", k: int = 5, shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:  # noqa: ANN001
    """(query_id, rank, vec_id, score): the k best rows of every row for which ``is_query`` holds."""
    from pyspark.sql import Window as W

    vecs = materialize(quantised(vectors, ids, vector), "vectors")
    n = vecs.count()
    n_queries = vecs.filter(is_query(F.col("vec_id"))).count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // block_rows))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    base = vecs.withColumn("shard", home).withColumn("dim", F.size("v"))
    asked = base.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), *(F.col(c).alias(c) for c in ("v", "shard", "dim"))).dropDuplicates(["query_id", "v"])
    first = _meet(base.withColumn("block", F.lit(0)), asked.withColumn("block", F.lit(0)).withColumn("floor", F.lit(None).cast("double")), k)
    own = materialize(first, "own-shard")
    floors = own.groupBy("query_id").agg(F.min("score").cast("double").alias("floor"), F.count("*").alias("n"))
    floors = floors.select("query_id", F.when(F.col("n") >= k, F.col("floor")).alias("floor"))
    block = F.pmod(F.xxhash64(F.col("query_id"), F.lit(1)), F.lit(blocks)).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("shard"))
    sent = asked.join(floors, "query_id", "left").withColumn("block", block).withColumn("shard", F.explode(others))
    spread = base.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rest = _meet(spread, sent, k)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.unionByName(rest).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
