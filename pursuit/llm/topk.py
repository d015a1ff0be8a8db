"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Vectors and queries are dealt into cells of about so many rows.
VECTORS, QUERIES = 16384, 1024


class Lists:
    """Sorted lists of one cell: for each dimension, the rows by falling component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        rank = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[rank], x[rank]
        self.order = np.argsort(-self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, self.order, axis=0)

    def search(self, q: np.ndarray, own: int, k: int, share: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but those with id ``own``; ties to the smaller id.

        Sorted access goes down all lists where q is positive and up those where it is negative, twice
        as deep each round. No row that wasn't seen can score above the sum of q times the components
        reached, so the search ends when the k-th score is above that bound, or no row is unseen.
        ``share`` receives the shares of rows seen and of the lists' lengths read.
        """
        n, dims = len(self.ids), np.flatnonzero(q)
        seen, ids, scores = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0)
        depth, done = 0, min(n, 8)
        up = q[dims] > 0
        while True:
            if len(dims):
                top = self.order[depth:done, dims[up]].ravel()
                low = self.order[n - done : n - depth, dims[~up]].ravel()
                new = np.zeros(n, bool)
                new[top] = new[low] = True
                new &= ~seen
            else:
                new = ~seen
                done = n
            at = np.flatnonzero(new)
            seen[at] = True
            ids, scores = np.concatenate([ids, self.ids[at]]), np.concatenate([scores, self.x[at] @ q])
            keep = ids != own
            ids, scores = ids[keep], scores[keep]
            rank = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[rank], scores[rank]
            edge = np.where(up, self.sorted[done - 1, dims], self.sorted[n - done, dims]) if n else q[dims]
            if done >= n or seen.all() or (len(scores) == k and scores[-1] > edge @ q[dims]):
                if share is not None:
                    share.append((seen.mean(), done / n))
                return ids, scores
            depth, done = done, min(n, done * 2)


def quantised(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows with null or non-finite parts are left out."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.where(~bad).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def top_k(vectors: DataFrame, every: int, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest integer inner products of each query, itself left out.

    Queries are the rows whose id is divisible by ``every``. Vectors are dealt into cells of about
    16,384 and meet the queries in blocks of 1,024: a task holds one cell and one block, whatever
    the input, and each cell returns k rows a query, which a ranking per query merges.

    Null vectors, vectors with null, NaN or infinite components and null ids take no part. Vectors of
    another length than the query's don't meet it. Equal scores go to the smaller id. Repeated ids:
    the first row by components is the query, other ids' rows each count. Empty tables give no rows.
    """
    small_batches(vectors.sparkSession, 2000)
    rows = cut(quantised(vectors, scale, id_col, vec_col), "vectors").withColumn("dim", F.size("v"))
    n = rows.count()
    cells, blocks = max(1, -(-n // VECTORS)), max(1, -(-n // (every * QUERIES)))
    queries = rows.where(F.col("id") % every == 0).groupBy("id", "dim").agg(F.min("v").alias("v"))
    q = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    x = rows.withColumn("cell", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(cells)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            lists = Lists(*_matrix(left))
            for own, q in zip(*_matrix(right)):
                ids, scores = lists.search(q, own, k)
                out += [(int(own), int(i), int(s)) for i, s in zip(ids, scores)]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    key = ["dim", "cell", "block"]
    found = x.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column("id").to_numpy()
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)
