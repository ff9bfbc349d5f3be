"""Helpers that several operators share."""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Bytes or characters that a task works on at once; bounds its arrays.
BLOCK = 1 << 20


def documents(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (string, null as empty) of a documents-like table."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that none of ``columns`` has, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of text that a partition of a checkpoint stands for at least, where there are so many.
PART_BYTES = 8 << 20


def parts_for(docs: DataFrame) -> int:
    """Partitions for what is made of the texts of ``docs`` and grows with them, by the bytes of all texts.

    An upper bound for ``coalesce``: where the session deals rows out more finely, each partition costs its files and,
    without Hadoop's native library, two processes that the executor starts for their permissions.
    """
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0]
    return max(1, -(-(total or 0) // PART_BYTES))


def materialise(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder: lost executors do not lose it.

    The shuffle files behind it are of no more use and are removed at once.  parts: partitions at most.
    """
    if parts is not None:
        df = df.coalesce(parts)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan made under the setting
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def released(work: Callable) -> Callable:
    """A function for ``mapInArrow`` whose worker process, which Spark keeps for later tasks, gives memory that is free back when it ends."""
    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)
    return run


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its offsets (one more than rows); nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if large else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def text_runs(col: pa.Array, most: int) -> Iterator[tuple[int, int, list[str]]]:
    """Consecutive rows of a string column of about ``most`` bytes: only these become Python strings."""
    for a, b in runs(np.diff(utf8(col)[1]), most):
        yield a, b, col.slice(a, b - a).fill_null("").to_pylist()


def runs(sizes: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Consecutive rows whose sizes add up to ``most`` or that are one larger row."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def segments(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every segment, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
