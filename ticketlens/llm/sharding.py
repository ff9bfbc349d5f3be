"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in source blocks by a seeded hash.  How many rows of each block go to
each target block is drawn exactly (multivariate hypergeometric) before a row
moves, so every target's size is exact.  Each source block is permuted and cut
by its row of the matrix, the rows are exchanged, and each target block is
permuted again.  A shard is a run of target blocks, so no task holds a shard.

Only narrow rows move (id, size, checksum).  Law: ``rows``, counts at most one
apart.  Null texts have size 1 and the checksum of no bytes; repeated rows are
rows of their own; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise

#: Rows of a source or target block, and the most blocks on a side (the matrix is at most its square).
BLOCK_ROWS, MAX_BLOCKS = 1 << 16, 1024


def communication_matrix(sources: np.ndarray, targets: np.ndarray, seed: int) -> np.ndarray:
    """How many rows go from each source to each target; rows and columns add up exactly."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left, out = targets.astype(np.int64).copy(), []
    for n in sources.tolist():
        row = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= row
        out.append(row)
    return np.array(out, np.int64).reshape(len(sources), len(targets))


def shard_rows(docs: DataFrame, n_shards: int = 8, seed: int = 20240607,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    rows = documents(docs).select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"),
                                  F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
    rows = materialise(rows)
    n = rows.count()
    blocks = int(min(MAX_BLOCKS, max(1, -(-n // block_rows))))
    per_shard = -(-blocks // n_shards)
    key = ["doc_id", "size", "text_crc32"]
    rows = rows.withColumn("src", F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(blocks)).cast("int"))
    got = {r["src"]: r["n"] for r in rows.groupBy("src").agg(F.count("*").alias("n")).collect()}  # at most MAX_BLOCKS rows
    sizes = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    targets = np.array([z // per_shard + (b < z % per_shard) for z in sizes for b in range(per_shard)], np.int64)
    upto = np.cumsum(communication_matrix(np.array([got.get(b, 0) for b in range(blocks)], np.int64), targets, seed), axis=1)
    first = (np.cumsum(targets) - targets).reshape(n_shards, per_shard)
    first = (first - first[:, :1]).reshape(-1)

    def deal(batches):
        for batch in batches:
            src, place = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            dst = np.empty(len(src), np.int32)
            for s in np.unique(src):
                mine = src == s
                dst[mine] = np.searchsorted(upto[s], place[mine], side="left")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(dst), pa.array(first[dst])],
                                             names=[*key, "dst", "first"])

    def permuted(block: str, salt: int):
        return F.row_number().over(Window.partitionBy(block).orderBy(F.xxhash64(*key, F.lit(seed + salt)), *key))

    sent = rows.select(*key, "src", permuted("src", 1).alias("place")).mapInArrow(
        deal, "doc_id long, size long, text_crc32 long, dst int, first long")
    return sent.select(*key, (F.col("dst") / per_shard).cast("int").alias("shard"),
                       (F.col("first") + permuted("dst", 2) - 1).alias("slot"))
