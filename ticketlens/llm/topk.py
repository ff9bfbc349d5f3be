"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt into blocks of bounded size.  In a block every dimension has a
sorted list; rows are taken in the order in which they first appear at either
end of any list.  After depth r a row not yet seen lies, in every dimension,
between the r-th smallest and r-th largest value, which bounds its score; a
query stops when its k-th result beats that bound.  Queries are dealt to every
block and met in batches; the blocks' results merge by rank.

Components become floor(scale * x) with x as double and scores are exact
integers.  Vectors that are null or hold a null or non-finite component take no
part; missing components of shorter vectors count as 0.  Rows with one vec_id
count once (the smallest vector); a null vec_id takes no part.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK_ROWS, QUERY_BATCH = 8192, 512
_NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, column: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and the integer vector of every row that takes part."""
    sound = F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    ints = F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull()).where(sound)
            .select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))
            .groupBy("vec_id").agg(F.min("v").alias("v")))


class ThresholdBlock:
    """The sorted lists of one block of vectors (exact while sums stay below 2**53)."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        n = len(ids)
        lists = np.argsort(v, axis=0, kind="stable")
        rank = np.empty_like(lists)
        np.put_along_axis(rank, lists, np.broadcast_to(np.arange(n)[:, None], lists.shape), axis=0)
        depth = np.minimum(rank, n - 1 - rank).min(axis=1) if v.shape[1] else np.zeros(n, np.int64)
        order = np.argsort(depth, kind="stable")
        self.sorted = np.take_along_axis(v, lists, axis=0)
        self.v, self.ids, self.depth = v[order], ids[order], depth[order]
        self.by_id = np.empty(n, np.int64)
        self.by_id[np.argsort(self.ids, kind="stable")] = np.arange(n)
        self.visited = 0

    def top(self, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vec_id, score) of each query's k best."""
        n = len(self.ids)
        best = np.full((len(qids), k), _NONE)
        active, r, done = np.arange(len(qids)), 1, 0
        while done < n and len(active):
            upto = int(np.searchsorted(self.depth, r, side="left"))
            score = (q[active] @ self.v[done:upto].T).astype(np.int64)
            key = score * n + (n - 1 - self.by_id[done:upto])      # ties: the smaller id is larger
            key[qids[active][:, None] == self.ids[done:upto][None, :]] = _NONE
            both = np.concatenate([best[active], key], axis=1)
            best[active] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            self.visited += score.size
            done = upto
            if done < n:
                low, high = self.sorted[r], self.sorted[n - 1 - r]
                bound = np.maximum(q[active] * low, q[active] * high).sum(axis=1)
                kth = best[active].min(axis=1)
                active = active[(kth == _NONE) | (kth // n <= bound)]
            r *= 2
        row, place = np.nonzero(best != _NONE)
        key = best[row, place]
        id_at = np.sort(self.ids)
        return row, id_at[n - 1 - key % n], key // n


def _exact_top(ids, v, qids, q, k):
    """Plain exact integers, for components so large that doubles would round."""
    rows = []
    for i, (qid, x) in enumerate(zip(qids.tolist(), q.tolist())):
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(x, y)), j) for j, y in zip(ids.tolist(), v.tolist()) if j != qid)[:k]
        rows += [(i, j, -s) for s, j in scores]
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    """Rows of integer lists as doubles, filled up with zeros."""
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), d), np.int64)
    flat = lists.flatten().to_numpy()
    if (n == d).all():
        return flat.reshape(len(lists), d)
    out[np.repeat(np.arange(len(lists)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vectors, queries: (vec_id, v integer list).  Result: query_id, rank, vec_id, score."""
    vectors = materialise(vectors)
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks, d = max(1, -(-size["n"] // block_rows)), size["d"] or 0
    rows = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "vec_id", "v")
    met = rows.unionByName(asked).repartition("block").sortWithinPartitions("block", "asks", "vec_id")

    def answer(held, qids, q):
        ids, v, lists = held
        most = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(d, 1)
        if most * len(ids) < 2.0 ** 53:
            if not lists:
                lists.append(ThresholdBlock(ids, v.astype(np.float64)))
            row, vec, score = lists[0].top(qids, q.astype(np.float64), k)
        else:
            row, vec, score = _exact_top(ids, v, qids, q, k)
        return pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    def work(batches):
        block, ids, v, held = None, [], [], None
        for batch in batches:
            blk, asks, vid = (c.to_numpy() for c in batch.columns[:3])
            edges = [0, *(np.flatnonzero((np.diff(blk) != 0) | (np.diff(asks) != 0)) + 1).tolist(), len(blk)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if blk[a] != block:
                    block, ids, v, held = blk[a], [], [], None
                part = _matrix(batch.column(3).slice(a, b - a), d)
                if not asks[a]:
                    ids.append(vid[a:b])
                    v.append(part)
                    continue
                if held is None:
                    if not ids:
                        continue
                    held = (np.concatenate(ids), np.concatenate(v), [])
                for i in range(0, b - a, QUERY_BATCH):
                    yield answer(held, vid[a + i:min(b, a + i + QUERY_BATCH)], part[i:i + QUERY_BATCH])
    partial = met.mapInArrow(work, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
