"""Approximate nearest neighbours: a vantage-point tree for each shard, searched by many queries at once.

On vectors of length one the Euclidean distance is a metric and orders as the cosine does. A node keeps a vantage
point, the median distance of its vectors to it, and the vectors within and beyond it. By the triangle inequality a
query at distance d from the vantage point needs the inner part only if (d - median) is at most its reach (the
distance of its k-th best so far), and the outer part only if (median - d) is. ``factor`` multiplies that
difference: 1 restores exact search, more prunes more.

Distances come from rounded products, so they only say what can't be among the k best, with room for their largest
error. What may be is ordered by its cosine on the original vectors, ties by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a shard's tree, vectors in a leaf, pairs whose cosines are computed at a time.
SHARD_ROWS = 16_384
LEAF = 256
PAIRS = 1 << 16


def product_error(width: int) -> float:
    """More than two rounded products of unit vectors of ``width`` components, or their cosines, can differ by."""
    return 8 * (width + 8) * float(np.finfo(np.float64).eps)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision, summed from the first component to the last."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


class Tree:
    """A vantage-point tree over distinct vectors, each of which stands for the ids of its copies."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, leaf: int = LEAF):
        self.k, self.leaf = k, leaf
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        _, first, group = np.unique(x, axis=0, return_index=True, return_inverse=True)
        by = np.argsort(group.reshape(-1), kind="stable")  # ids ascend within a group of copies
        self.ids = ids[by]
        self.start = np.searchsorted(group.reshape(-1)[by], np.arange(len(first) + 1))
        self.many = np.minimum(np.diff(self.start), k + 1)  # no query takes more copies than its k and its own
        self.x = x[first]
        self.unit = self.x / np.linalg.norm(self.x, axis=1, keepdims=True)
        self.error = product_error(x.shape[1])
        self.room = 2 * (2 * self.error) ** 0.5  # of a difference of distances: sqrt(a + e) - sqrt(a) <= sqrt(e)
        self.root = self._grow(np.arange(len(self.unit)))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        d = _distance(self.unit[rows], self.unit[rows[:1]])[:, 0]
        far = rows[d.argmax()]  # a vantage point at the rim splits better than one in the middle
        d = _distance(self.unit[rows], self.unit[far : far + 1])[:, 0]
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        return far, d[order[half - 1]], d[order[half]], self._grow(rows[order[:half]]), self._grow(rows[order[half:]])

    def search(self, own: np.ndarray, queries: np.ndarray, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """The k best of each query (its id in ``own``): ids (-1: none) and cosines, nearest first, ties by id."""
        self.own, self.queries = own, queries
        self.near = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        self.best = np.full((len(queries), self.k), -np.inf)
        self.found = np.full((len(queries), self.k), -1, dtype=np.int64)
        self._visit(self.root, np.arange(len(queries)), factor)
        return self.found, self.best

    def _visit(self, node, who: np.ndarray, factor: float) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            step = max(1, PAIRS // max(1, len(node)))
            for a in range(0, len(who), step):
                self._leaf(node, who[a : a + step])
            return
        point, inner, outer, within, beyond = node
        d = _distance(self.near[who], self.unit[point : point + 1])[:, 0]
        near = d <= (inner + outer) / 2
        for first in (True, False):
            side, own = who[near == first], d[near == first]
            self._visit(within if first else beyond, side, factor)
            reach = np.sqrt(np.maximum(2 - 2 * np.maximum(self.best[side, -1], -1), 0)) + self.room
            gap = (outer - own) if first else (own - inner)
            self._visit(beyond if first else within, side[factor * gap <= reach], factor)

    def _leaf(self, node: np.ndarray, who: np.ndarray) -> None:
        """Merge what a leaf may add: vectors whose rounded cosine isn't surely below the k-th best."""
        about = self.near[who] @ self.unit[node].T
        least = self.best[who, -1]
        if len(node) > self.k + 1:  # one more than k, as one may be the query itself
            least = np.maximum(least, np.partition(about, -self.k - 1, axis=1)[:, -self.k - 1])
        q, v = np.nonzero(about >= (least - self.error)[:, None])
        if not len(q):
            return
        score = cosine(self.queries[who[q]], self.x[node[v]])
        times = self.many[node[v]]
        which = np.repeat(self.start[node[v]], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        q, score, ids = np.repeat(q, times), np.repeat(score, times), self.ids[which]
        other = ids != self.own[who[q]]
        had = self.found[who] >= 0
        q = np.concatenate((q[other], np.nonzero(had)[0]))
        score = np.concatenate((score[other], self.best[who][had]))
        ids = np.concatenate((ids[other], self.found[who][had]))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.best[who[q[keep]], rank[keep]] = score[keep]
        self.found[who[q[keep]], rank[keep]] = ids[keep]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _one_an_id(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that repeat an id that with the smallest vector."""
    first = np.unique(ids, return_index=True)[1]
    if len(first) < len(ids):
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        first = np.unique(ids, return_index=True)[1]
    return ids[first], x[first]


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` nearest by cosine of each query (id divisible by ``every``) among all rows but its own.

    Rows: query_id, rank (from 1, nearest first, ties to the smaller id), vec_id, score. Vectors that are null,
    zero, or hold null or non-finite components, and rows with a null id take no part; so do those of another
    length than most, as no cosine is defined. Rows that repeat an id stand for one, that with the smallest
    vector. Fewer rows if there are fewer candidates; none for an empty table; other columns are ignored.

    Each shard holds about ``shard_rows`` vectors, which are sent to its task once and grown into one tree; the queries
    stream past it. A shard gives its k best for a query, so that what is merged is k x shards a query.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    shards = max(1, ceil(sizes[0]["count"] / shard_rows))
    good = good.filter(F.size("v") == sizes[0]["d"])
    base = good.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "v")
    asked = good.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    query = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            all_shards, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (all_shards[1:] != all_shards[:-1]) | (kinds[1:] != kinds[:-1]), [True]))) if batch.num_rows else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if all_shards[a] != shard:
                    shard, held, tree = all_shards[a], [], None
                part = batch.slice(a, b - a)
                ids, x = part.column(2).to_numpy(), _matrix(part.column(3))
                if kinds[a] == 0:
                    held.append((ids, x))
                    continue
                if not held and tree is None:
                    continue
                if tree is None:
                    tree, held = Tree(*_one_an_id(np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])), k), []
                found, score = tree.search(ids, x, factor)
                row, rank = np.nonzero(found >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found[row, rank]), pa.array(score[row, rank])], ["query_id", "vec_id", "score"])

    streamed = base.unionByName(query).repartition("shard").sortWithinPartitions("shard", "kind")
    found = streamed.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS n FROM v
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
  list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.n * c.n) AS score
  FROM g q JOIN g c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 AND q.n > 0 AND c.n > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
