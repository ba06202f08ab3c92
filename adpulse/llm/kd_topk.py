"""Exact highest inner products by KD-trees, one for each shard of the vectors.

Vectors are turned into integers, dealt over shards by their id, and each shard
builds a KD-tree (median splits of the widest dimension, tight bounding boxes).
Every query first searches the shard that holds it; the k-th score found there
goes with it to all the other shards, where boxes that cannot reach it are
skipped.  Within a shard the search is best-first by the bound of query and box.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adpulse.llm.runtime import keep, prepare

LEAF_ROWS = 64
SHARD_ROWS = 4096      # vectors of a tree
QUERY_ROWS = 4096      # queries that one task takes to one tree
SCALE = 256
_EXACT = 2.0 ** 53     # integers below this are exact as doubles
_LONG = (1 << 63) - 1


class KDTree:
    """Median splits until a node is small or all its vectors are equal."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(vectors))
        self.low, self.high, self.child, self.span = [], [], [], []
        todo = [(0, len(vectors), -1, 0)] if len(vectors) else []
        while todo:
            a, b, parent, side = todo.pop()
            here = vectors[self.order[a:b]]
            low, high = here.min(axis=0), here.max(axis=0)
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.child.append([-1, -1])
            self.span.append((a, b))
            if parent >= 0:
                self.child[parent][side] = node
            wide = int(np.argmax(high - low)) if here.shape[1] else 0
            if b - a > leaf_rows and here.shape[1] and high[wide] > low[wide]:
                mid = (a + b) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(here[:, wide], mid - a)]
                todo += [(a, mid, node, 0), (mid, b, node, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.vectors = vectors[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest inner product that each query can have with a vector in each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def _best_first(tree: KDTree, ids: np.ndarray, query: np.ndarray, own: int, bound: np.ndarray, floor: float, k: int) -> list[tuple[float, int]]:
    """The k best (score, -id) of at least ``floor``, the query's own id left out."""
    best: list[tuple[float, int]] = []
    heap = [(-bound[0], 0)]
    while heap:
        reach, node = heapq.heappop(heap)
        if -reach < floor:
            break
        left, right = tree.child[node]
        if left >= 0:
            for c in (left, right):
                if bound[c] >= floor:
                    heapq.heappush(heap, (-bound[c], c))
            continue
        a, b = tree.span[node]
        score = tree.vectors[a:b] @ query
        for i in np.flatnonzero(score >= floor).tolist():
            item = (score[i], -int(ids[tree.order[a + i]]))
            if item[1] == -own:
                continue
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
            if len(best) == k and best[0][0] > floor:
                floor = best[0][0]
    return best


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """floor(SCALE * x) of the rows, all of one length, as doubles."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int, leaf_rows: int = LEAF_ROWS) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's k best of the shard, none below its floor."""
    out: list[tuple[int, int, int]] = []
    if not len(vectors) or not len(queries):
        return out
    with np.errstate(over="ignore"):
        reach = max(abs(vectors).max(initial=0), 1) * max(abs(queries).max(initial=0), 1) * max(vectors.shape[1], 1)
    if not reach < _EXACT:                         # beyond doubles: whole numbers of any size
        big = np.array([[int(x) for x in v] for v in vectors], dtype=object).reshape(vectors.shape)
        for q, v in zip(query_ids.tolist(), queries):
            score = big @ np.array([int(x) for x in v], dtype=object)
            rows = sorted((-max(-_LONG, min(_LONG, int(s))), i) for s, i in zip(score, ids.tolist()) if i != q)
            out += [(q, i, -s) for s, i in rows[:k]]
        return out
    tree = KDTree(vectors, leaf_rows)
    for at in range(0, len(queries), 256):
        bound = tree.bounds(queries[at: at + 256])
        for j, q in enumerate(query_ids[at: at + 256].tolist()):
            for s, i in _best_first(tree, ids, queries[at + j], q, bound[j], floors[at + j], k):
                out.append((q, -i, int(s)))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k highest inner products, ties to the smaller id.

    Both tables have ``id_col`` (long) and ``vector_col``.  Components become
    floor(256 * x), x as double.  Rows with a null id, a null vector, or a null
    or non-finite component take no part, on either side.  A query meets every
    row but those with its own id; a query id that is repeated counts once, with
    the smallest of its vectors.  Only vectors of the query's length are compared.
    Scores beyond a long are cut to its ends.
    """
    spark = prepare(vectors.sparkSession)

    def sound(df: DataFrame) -> DataFrame:
        x = F.col("_v")
        ok = F.col("_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
        return df.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v")).where(ok).withColumn("_n", F.size("_v"))

    rows = sound(vectors)
    asked = keep(sound(queries).groupBy("_id").agg(F.min("_v").alias("_v")).withColumn("_n", F.size("_v")), "asked")
    n_rows, n_asked = rows.count(), asked.count()
    shards, blocks = max(1, -(-n_rows // shard_rows)), max(1, -(-n_asked // query_rows))
    shard = F.pmod(F.xxhash64("_id"), F.lit(shards))
    block = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = rows.withColumn("_shard", shard)
    names = ["query_id", "vec_id", "score"]

    def run(table: pa.Table, asks: pa.Table) -> pa.Table:
        found = search(table.column("_id").to_numpy(), _matrix(table.column("_v")), asks.column("_id").to_numpy(), _matrix(asks.column("_v")),
                       asks.column("_floor").to_numpy(), k)
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(names)})

    def searched(asks: DataFrame, data: DataFrame) -> DataFrame:
        keys = ["_n", "_shard", "_block"]
        return data.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")

    dealt = held.withColumn("_block", every(blocks))
    home = asked.withColumn("_shard", shard).withColumn("_block", block).withColumn("_floor", F.lit(float("-inf")))
    first = keep(searched(home, dealt), "home")
    floors = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("_floor"))
    away = (asked.join(floors, asked["_id"] == floors["query_id"], "left").drop("query_id")
            .withColumn("_floor", F.coalesce("_floor", F.lit(float("-inf")))).withColumn("_block", block)
            .withColumn("_own", shard).withColumn("_shard", every(shards)).where("_shard != _own").drop("_own"))
    found = first.unionByName(searched(away, dealt))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
